"""A document database and a search service for tests. Executors import this module, so state is in files."""

import json
import os


class Database:
    def _events(self, options):
        with open(options["uri"]) as f:
            return [json.loads(x) for x in f]

    def parts(self, options, n):
        return [json.dumps([i * 3 // n, (i + 1) * 3 // n]) for i in range(n)]

    def snapshot(self, options, part):
        for i in range(*json.loads(part)):
            yield {"_id": i, "name": f"stored {i}"}

    def start(self, options):
        return ""

    def latest(self, options):
        return f"{len(self._events(options)):08d}"

    def changes(self, options, after, upto):
        yield from self._events(options)[int(after or 0) : int(upto)]


    def upsert(self, options, documents):
        with open(f"{options['uri']}-{os.getpid()}-{documents[0]['_id']}", "w") as f:
            json.dump(documents, f)


def database():
    return Database()


def send(url, body, headers):
    folder = os.environ.get("TRIBUTARY_TEST_SENT", "/tmp/tributary-sent")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{os.getpid()}-{abs(hash(body))}", "w") as f:
        f.write(body)
