"""A source of records that a web service gives out, by the standard library alone."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator


class HttpClient:
    """Reads lines of JSON from url, a service that numbers its records from 1 on.

    It answers ?latest=1 with the number of its last record, and ?after=a&upto=b with the records from a + 1 to b, one a
    line and no fewer. Options that begin with header. are sent as headers. Each part of a first load, and each batch,
    is one request, so max_records bounds what a request asks for.
    """

    def _get(self, options: dict[str, str], **query: object) -> str:
        url = options["url"] + ("&" if "?" in options["url"] else "?") + urllib.parse.urlencode(query)
        headers = {k.removeprefix("header."): v for k, v in options.items() if k.startswith("header.")}
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=float(options.get("timeout", "60"))) as answer:
            return answer.read().decode()

    def _records(self, options: dict[str, str], after: int, upto: int) -> Iterator[dict]:
        most = int(options.get("max_records", "10000"))
        for a in range(after, upto, most):
            b = min(a + most, upto)
            lines = [x for x in self._get(options, after=a, upto=b).splitlines() if x.strip()]
            if len(lines) != b - a:
                raise OSError(f"{options['url']} gave {len(lines)} of {b - a} records")
            yield from map(json.loads, lines)

    def parts(self, options: dict[str, str], n: int) -> list[str]:
        end = int(options.get("start_token") or self.latest(options))
        return [json.dumps([end * i // n, end * (i + 1) // n]) for i in range(n)]

    def snapshot(self, options: dict[str, str], part: str) -> Iterator[dict]:
        return self._records(options, *json.loads(part))

    def start(self, options: dict[str, str]) -> str:
        """After what a first load reads, if there is one; else the beginning."""
        return self.latest(options) if options.get("load_initial_data", "").lower() in ("1", "t", "true") else "0"

    def latest(self, options: dict[str, str]) -> str:
        return self._get(options, latest=1).strip()

    def changes(self, options: dict[str, str], after: str, upto: str) -> Iterator[dict]:
        return self._records(options, int(after or 0), int(upto))


def client() -> HttpClient:
    return HttpClient()
