"""A stand-in for a Redis client whose streams lie in a JSON file, so that workers see them too."""

import json
from pathlib import Path


def number(seq, top=False):
    ms, _, n = seq.partition("-")
    return int(ms), int(n) if n else (2**64 - 1 if top else 0)


class Fake:
    def __init__(self, path):
        self.path = Path(path)

    def _load(self):
        return json.loads(self.path.read_text())

    def _save(self, data):
        self.path.write_text(json.dumps(data))

    def add(self, key, rows):
        data = self._load() if self.path.exists() else {"streams": {}, "groups": {}}
        data["streams"].setdefault(key, []).extend(rows)
        self._save(data)

    def exists(self, key):
        return key in self._load()["streams"]

    def xrange(self, key, min="-", max="+", count=None):
        out = []
        for seq, fields in self._load()["streams"].get(key, []):
            n = number(seq)
            low = min == "-" or (n > number(min[1:]) if min.startswith("(") else n >= number(min))
            if low and (max == "+" or n <= number(max, True)):
                out.append((seq, fields))
        return out[:count]

    def xrevrange(self, key, count=None):
        return self._load()["streams"].get(key, [])[::-1][:count]

    def xinfo_groups(self, key):
        return [{"name": g, "last-delivered-id": v} for g, v in self._load()["groups"].get(key, {}).items()]

    def xgroup_create(self, key, group, id, mkstream=False):
        self.xgroup_setid(key, group, id)

    def xgroup_setid(self, key, group, id):
        data = self._load()
        data["groups"].setdefault(key, {})[group] = id
        self._save(data)


def client(url):
    return Fake(url)
