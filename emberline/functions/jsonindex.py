"""A structural index over many JSON texts at once.

The texts of a batch lie in one byte buffer. Bitmaps of quotes, brackets and
delimiters are built for the whole buffer, strings are told from structure by the
parity of a prefix sum over quotes, nesting depth is a prefix sum over brackets,
and every token's container follows from one sort by depth. Texts that break the
JSON grammar are found by the same arrays and leave no nodes. Nothing here loops
over bytes; Python only touches distinct scalars and the strings that are asked for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np

_OPEN_OBJ, _CLOSE_OBJ, _OPEN_ARR, _CLOSE_ARR, _COLON, _COMMA = b"{}[]:,"
_QUOTE, _BACKSLASH = b'"\\'
#: Token types besides the six structural bytes.
STRING, SCALAR = _QUOTE, 1
OBJECT, ARRAY = _OPEN_OBJ, _OPEN_ARR

_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WHOLE = re.compile(rb"-?(?:0|[1-9][0-9]*)")

_STRUCTURAL = np.zeros(256, bool)
_STRUCTURAL[list(b"{}[]:,")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


def _none(n: int = 0) -> np.ndarray:
    return np.full(n, -1, np.int64)


class JsonIndex:
    """Nodes of many texts.

    A node is a value: its token's number. ``row`` is its text, ``kind`` one of
    OBJECT, ARRAY, STRING, SCALAR, ``parent`` the container's node (-1 at the top),
    ``key`` the token of its key in an object (-1 elsewhere), ``pos`` its place in
    an array. Of repeated keys in one object the last counts.
    """

    def __init__(self, texts: Sequence[bytes | None]):
        raw = [b"" if t is None else t for t in texts]
        self.n = len(raw)
        self.buf = b"\n".join(raw) + b"\n"
        self.valid = np.zeros(self.n, bool)
        self._index(raw)

    def _index(self, raw: Sequence[bytes]) -> None:
        b = np.frombuffer(self.buf, np.uint8)
        n = len(b)
        lengths = np.fromiter((len(t) + 1 for t in raw), np.int64, self.n)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if self.n else np.zeros(0, np.int64)
        row_of = np.repeat(np.arange(self.n, dtype=np.int32), lengths)
        bad = lengths <= 1

        def spoil(at: np.ndarray) -> None:
            bad[row_of[at]] = True

        # quotes that no odd run of backslashes escapes
        slash = b == _BACKSLASH
        escaped = np.zeros(n, bool)
        at_slash = np.flatnonzero(slash)
        if len(at_slash):
            last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(n)))
            before = np.arange(n - 1) - last_other[:-1]
            escaped[1:] = (before & 1) == 1
        quote = (b == _QUOTE) & ~escaped

        # parity of quotes since the row's start
        seen = np.cumsum(quote, dtype=np.int64)
        base = np.where(starts > 0, seen[starts - 1], 0) if self.n else seen[:0]
        odd = ((seen - base[row_of]) & 1).astype(bool)
        bad |= odd[starts + lengths - 1] if self.n else bad
        opening, closing = quote & odd, quote & ~odd
        outside = ~odd & ~closing

        inside = odd & ~opening
        spoil(np.flatnonzero(inside & (b < 32)))
        if len(at_slash):
            spoil(at_slash[~odd[at_slash]])
            lead = at_slash[~escaped[at_slash]]
            follow = b[np.minimum(lead + 1, n - 1)]
            spoil(lead[~_ESCAPABLE[follow]])
            uni = lead[follow == ord("u")]
            for k in range(2, 6):
                spoil(uni[~_HEX[b[np.minimum(uni + k, n - 1)]]])

        # tokens: structural bytes, strings, runs of anything else
        struct = outside & _STRUCTURAL[b]
        other = outside & ~struct & ~_SPACE[b]
        edge = np.diff(np.concatenate([[False], other, [False]]).astype(np.int8))
        s_from, s_to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        open_at, close_at = np.flatnonzero(opening), np.flatnonzero(closing)
        if len(open_at) != len(close_at):  # a text ends within a string: match by row
            ends = np.searchsorted(close_at, open_at)
            close_at = np.where(ends < len(close_at), np.append(close_at, n - 1)[np.minimum(ends, len(close_at))], n - 1)
        struct_at = np.flatnonzero(struct)

        frm = np.concatenate([struct_at, open_at, s_from])
        to = np.concatenate([struct_at + 1, close_at + 1, s_to])
        kind = np.concatenate([b[struct_at], np.full(len(open_at), STRING, np.uint8), np.full(len(s_from), SCALAR, np.uint8)])
        order = np.argsort(frm, kind="stable")
        frm, to, kind = frm[order], to[order], kind[order]
        row = row_of[frm].astype(np.int64)
        m = len(frm)

        scalar = np.flatnonzero(kind == SCALAR)
        known: dict[bytes, bool] = {b"true": True, b"false": True, b"null": True}
        for i in scalar:
            text = self.buf[frm[i] : to[i]]
            fine = known.get(text)
            if fine is None:
                fine = known[text] = _NUMBER.fullmatch(text) is not None
            if not fine:
                bad[row[i]] = True

        self.frm, self.to, self.kind, self.row = frm, to, kind, row
        self.parent, self.key, self.pos, self.end = _none(m), _none(m), _none(m), to.copy()
        self.is_value = np.zeros(m, bool)
        if not m:
            return

        # depth by prefix sum, from zero in each row
        opener = (kind == _OPEN_OBJ) | (kind == _OPEN_ARR)
        closer = (kind == _CLOSE_OBJ) | (kind == _CLOSE_ARR)
        step = opener.astype(np.int64) - closer
        total = np.cumsum(step)
        first = np.concatenate([[True], row[1:] != row[:-1]])
        last = np.concatenate([first[1:], [True]])
        has_token = np.zeros(self.n, bool)
        has_token[row] = True
        bad |= ~has_token
        start_of = np.maximum.accumulate(np.where(first, np.arange(m), 0))
        after = total - (total[start_of] - step[start_of])
        before = after - step
        bad[row[(after < 0)]] = True
        bad[row[last & (after != 0)]] = True

        # the container of a token: in order of (row, depth, place), the opener before it at its depth
        inner = np.where(closer, after, before)  # a closer's own container is the one it returns to; see below
        level = np.concatenate([np.where(closer, before, inner), after[opener]])
        who = np.concatenate([np.arange(m), np.flatnonzero(opener)])
        is_open = np.concatenate([np.zeros(m, bool), np.ones(int(opener.sum()), bool)])
        srt = np.lexsort((is_open, who, level, row[who]))
        ow = np.where(is_open[srt], who[srt], -1)
        group = np.concatenate([[True], (level[srt][1:] != level[srt][:-1]) | (row[who[srt]][1:] != row[who[srt]][:-1])])
        at = np.arange(len(srt))
        group_at = np.maximum.accumulate(np.where(group, at, 0))
        last_at = np.maximum.accumulate(np.where(ow >= 0, at, -1))
        holder = np.where(last_at >= group_at, ow[np.maximum(last_at, 0)], -1)
        inside_of = _none(m)
        plain = ~is_open[srt]
        inside_of[who[srt][plain]] = holder[plain]  # for a closer: the opener it closes

        ctx = np.where(inside_of >= 0, kind[np.maximum(inside_of, 0)], 0)
        prev = np.where(first, 0, np.concatenate([[0], kind[:-1]]))
        second = np.concatenate([[False, False], row[2:] == row[:-2]]) if m > 1 else np.zeros(m, bool)
        prev2 = np.where(second, np.concatenate([[0, 0], kind[:-2]])[:m], 0)

        starts_value = opener | (kind == STRING) | (kind == SCALAR)
        after_value = ((prev == STRING) | (prev == SCALAR) | (prev == _CLOSE_OBJ) | (prev == _CLOSE_ARR))
        whole = after_value & ((ctx == _OPEN_ARR) | (prev == _CLOSE_OBJ) | (prev == _CLOSE_ARR) | (prev2 == _COLON))
        root, arr, obj = ctx == 0, ctx == _OPEN_ARR, ctx == _OPEN_OBJ
        is_key = obj & (kind == STRING) & ((prev == _OPEN_OBJ) | (prev == _COMMA))
        fine = np.zeros(m, bool)
        fine |= starts_value & root & first
        fine |= starts_value & arr & ((prev == _OPEN_ARR) | (prev == _COMMA))
        fine |= starts_value & obj & (prev == _COLON)
        fine |= is_key
        key_before = obj & (prev == STRING) & ((prev2 == _OPEN_OBJ) | (prev2 == _COMMA))
        fine |= (kind == _COLON) & key_before
        fine |= (kind == _COMMA) & (arr | obj) & whole
        fine |= (kind == _CLOSE_OBJ) & obj & ((prev == _OPEN_OBJ) | whole)
        fine |= (kind == _CLOSE_ARR) & arr & ((prev == _OPEN_ARR) | whole)
        bad[row[~fine]] = True
        self.valid = ~bad

        ok = self.valid[row]
        value = starts_value & ~is_key & ok
        self.is_value = value
        self.parent = np.where(value, inside_of, -1)
        self.key = np.where(value & obj, np.arange(m) - 2, -1)
        closes = np.flatnonzero(closer & ok)
        self.end[inside_of[closes]] = to[closes]
        # the place in an array: commas of that array before it, counted by rank within the parent
        elements = np.flatnonzero(value & arr)
        if len(elements):
            by_parent = elements[np.lexsort((elements, self.parent[elements]))]
            head = np.concatenate([[True], self.parent[by_parent][1:] != self.parent[by_parent][:-1]])
            k = np.arange(len(by_parent))
            self.pos[by_parent] = k - np.maximum.accumulate(np.where(head, k, 0))

    # -- questions -----------------------------------------------------------

    def roots(self) -> np.ndarray:
        return np.flatnonzero(self.is_value & (self.parent < 0))

    def of_kind(self, nodes: np.ndarray, *kinds: int) -> np.ndarray:
        return nodes[np.isin(self.kind[nodes], kinds)]

    def raw(self, node: int) -> bytes:
        return self.buf[self.frm[node] : self.end[node]]

    def text(self, node: int) -> str:
        """A string's content, any other value's JSON text; a lone surrogate becomes '?'."""
        raw = self.raw(node)
        if self.kind[node] == STRING:
            if b"\\" in raw:
                return json.loads(raw, strict=False).encode("utf-8", "replace").decode("utf-8")
            raw = raw[1:-1]
        return raw.decode("utf-8", "replace")

    def is_null(self, nodes: np.ndarray) -> np.ndarray:
        return self._token_is(nodes, b"null")

    def is_whole(self, nodes: np.ndarray) -> np.ndarray:
        return np.fromiter((self.kind[i] == SCALAR and _WHOLE.fullmatch(self.raw(i)) is not None for i in nodes), bool, len(nodes))

    def _token_is(self, tokens: np.ndarray, text: bytes) -> np.ndarray:
        """Whether the tokens' bytes are ``text``; quotes included for strings."""
        b = np.frombuffer(self.buf, np.uint8)
        hit = (self.to[tokens] - self.frm[tokens]) == len(text)
        for k, c in enumerate(text):
            hit &= b[np.minimum(self.frm[tokens] + k, len(b) - 1)] == c
        return hit

    def member(self, objects: np.ndarray, name: str) -> np.ndarray:
        """Nodes under the key ``name`` directly in the given objects; the last of repeated keys."""
        wanted = np.zeros(len(self.frm) + 1, bool)
        wanted[objects] = True
        inside = np.flatnonzero(self.is_value & (self.key >= 0) & wanted[self.parent])
        keys = self.key[inside]
        hit = self._token_is(keys, json.dumps(name, ensure_ascii=False).encode())
        for i in np.flatnonzero(~hit & self._with_escape(keys)):
            hit[i] = json.loads(self.buf[self.frm[keys[i]] : self.to[keys[i]]], strict=False) == name
        nodes = inside[hit]
        if len(nodes) > 1:
            by_parent = nodes[np.lexsort((nodes, self.parent[nodes]))]
            nodes = by_parent[np.concatenate([self.parent[by_parent][1:] != self.parent[by_parent][:-1], [True]])]
        return nodes

    def _with_escape(self, tokens: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_slashes"):
            self._slashes = np.concatenate([[0], np.cumsum(np.frombuffer(self.buf, np.uint8) == _BACKSLASH)])
        return self._slashes[self.to[tokens]] > self._slashes[self.frm[tokens]]

    def elements(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, pos) of what the given values hold as a list: an array's elements, any other value itself at 0."""
        wanted = np.zeros(len(self.frm) + 1, bool)
        wanted[self.of_kind(nodes, ARRAY)] = True
        wanted[-1] = False
        inside = np.flatnonzero(self.is_value & wanted[self.parent])
        single = nodes[self.kind[nodes] != ARRAY]
        found = np.concatenate([inside, single])
        return found, np.concatenate([self.pos[inside], np.zeros(len(single), np.int64)])
