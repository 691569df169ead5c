"""Text of Outlook messages: a compound file (MS-CFB) whose streams are the properties of the mail (MS-OXMSG)."""

from __future__ import annotations

import re
import struct

from .plain import decode_words, sender

# The signature, marks that end a chain, and the numbers of the properties that are shown.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
LAST_SECTOR = 0xFFFFFFFA
STORAGE, STREAM, ROOT = 1, 2, 5
SUBJECT, SENDER_NAME, SENDER_ADDRESS, BODY, HTML, DISPLAY_NAME = "0037", "0C1A", "0C1F", "1000", "1013", "3001"
ENCODINGS = {"001f": "utf-16-le", "001e": "cp1252"}
RECIPIENT = "__recip_version1.0_"
# End of fixed values.


class Compound:
    """The storages and streams of a compound file by path, names in lower case."""

    def __init__(self, raw: bytes):
        if raw[:8] != SIGNATURE:
            raise ValueError("no compound file")
        self.raw = raw
        shift, mini_shift = struct.unpack_from("<HH", raw, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        first_dir, _, self.cutoff, first_mini, _, first_more, _ = struct.unpack_from("<IIIIIII", raw, 48)
        self.next = self._table(first_more)
        self.entries = self._directory(self._chain(first_dir))
        self.mini_next = self._numbers(self._chain(first_mini))
        root = next((e for e in self.entries if e[1] == ROOT), None)
        self.mini = self._chain(root[5])[: root[6]] if root else b""
        self.paths: dict[tuple[str, ...], tuple] = {}
        self._walk()

    @staticmethod
    def _numbers(data: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))

    def _sector(self, n: int) -> bytes:
        return self.raw[(n + 1) * self.size : (n + 2) * self.size]

    def _table(self, more: int) -> list[int]:
        """The next sector of each sector. Its own sectors are listed in the header and, beyond 109, in a chain of lists."""
        lists, seen = self._numbers(self.raw[76:512]), set()
        while more < LAST_SECTOR and more not in seen:
            seen.add(more)
            *numbers, more = self._numbers(self._sector(more)) or [LAST_SECTOR]
            lists += numbers
        return [n for at in lists if at < LAST_SECTOR for n in self._numbers(self._sector(at))]

    @staticmethod
    def _sectors(first: int, following: list[int]) -> list[int]:
        out, seen = [], set()
        while first < len(following) and first not in seen:
            seen.add(first)
            out.append(first)
            first = following[first]
        return out

    def _chain(self, first: int) -> bytes:
        return b"".join(map(self._sector, self._sectors(first, self.next)))

    @staticmethod
    def _directory(data: bytes) -> list[tuple]:
        """(name, kind, left, right, child, first sector, size)"""
        out = []
        for at in range(0, len(data) - 127, 128):
            length, kind = struct.unpack_from("<HB", data, at + 64)
            left, right, child = struct.unpack_from("<III", data, at + 68)
            first, size = struct.unpack_from("<IQ", data, at + 116)
            out.append((data[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace").lower(), kind, left, right, child, first, size & 0xFFFFFFFF))
        return out

    def _walk(self) -> None:
        todo, seen = [(e[4], ()) for e in self.entries if e[1] == ROOT], set()
        while todo:
            n, above = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            name, kind, left, right, child, _, _ = entry = self.entries[n]
            self.paths[*above, name] = entry
            todo += [(left, above), (right, above)]
            if kind == STORAGE:
                todo.append((child, (*above, name)))

    def stream(self, *path: str) -> bytes | None:
        entry = self.paths.get(tuple(p.lower() for p in path))
        if entry is None or entry[1] != STREAM:
            return None
        first, size = entry[5], entry[6]
        if size >= self.cutoff:
            return self._chain(first)[:size]
        w = self.mini_size
        return b"".join(self.mini[n * w : (n + 1) * w] for n in self._sectors(first, self.mini_next))[:size]


def _property(file: Compound, number: str, *storage: str) -> str:
    """A text property, as Unicode if it is there so, else in the Western code page; '' if it is missing."""
    for kind, encoding in ENCODINGS.items():
        found = file.stream(*storage, f"__substg1.0_{number}{kind}")
        if found is not None:
            return found.decode(encoding, "ignore").strip()
    return ""


def message(raw: bytes) -> str:
    """A heading with the sender, then sender, recipients and subject, and the body, as plain.mail has it for mails."""
    file = Compound(raw)
    who = _property(file, SENDER_NAME) or _property(file, SENDER_ADDRESS)
    storages = sorted(path[0] for path in file.paths if len(path) == 1 and path[0].startswith(RECIPIENT))
    to = dict.fromkeys(filter(None, (_property(file, DISPLAY_NAME, storage) for storage in storages)))
    body = _property(file, BODY) or re.sub("<[^>]+>", " ", _property(file, HTML))
    name = sender(who)
    shown = {"Von": who, "An": ", ".join(to), "Betreff": _property(file, SUBJECT)}
    top = [f"## Mail von {name}"] * bool(name) + [f"{k}: {v}" for k, v in shown.items() if v]
    return decode_words("\n".join([*top, "", body.strip()]))
