"""A structural index over a batch of JSON texts, built with array operations only.

All texts of an Arrow batch lie one after the other in one byte buffer. Bitmaps of quotes (less
the escaped ones), brackets and delimiters are taken from it; a running parity of quotes tells
what lies within strings, a running sum of brackets gives the nesting depth. From there on only
tokens are handled: spans of keys and values, each value's container, its key or its place in
a list. Nothing is done text by text, but for texts that hold JSON within JSON strings.
"""

from __future__ import annotations

import json
import re

import numpy as np

OBJECT, ARRAY, STRING, PRIMITIVE = 1, 2, 3, 4
_OPEN_OBJ, _CLOSE_OBJ, _OPEN_ARR, _CLOSE_ARR, _COMMA, _COLON, _QUOTE, _PRIM = range(1, 9)
_KIND = np.zeros(256, np.int8)
for _c, _k in zip(b"{}[],:", range(1, 7)):
    _KIND[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[list(b"0123456789+-.eE")] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
#: A string value that may hold JSON of its own.
_NESTED = re.compile(rb'"\s*(?:\\[nrt]\s*)*[\[{](?:\s|\\[nrt])*(?:\\"|[\[{\]}0-9tfn-])')


def _opened(value: object) -> object:
    """JSON in strings is opened however deep: each level doubles what escapes it, so a text has few."""
    if isinstance(value, str):
        s = value.strip()
        if s[:1] in ("{", "[", '"') and s[-1:] in ("}", "]", '"'):
            try:
                inner = json.loads(s)
            except (ValueError, RecursionError):
                return value
            return _opened(inner) if isinstance(inner, (dict, list, str)) else value
        return value
    if isinstance(value, list):
        return [_opened(v) for v in value]
    if isinstance(value, dict):
        return {k: _opened(v) for k, v in value.items()}
    return value


class _Raw(float):
    """A number that keeps its spelling."""

    def __new__(cls, text: str) -> _Raw:
        self = super().__new__(cls, text)
        self.text = text
        return self

    def __repr__(self) -> str:
        return self.text


def open_strings(text: bytes) -> bytes:
    """The same JSON with every string that holds a JSON object or list replaced by that; other text unchanged."""
    try:
        value = json.loads(text)
        return json.dumps(_opened(value), ensure_ascii=False).encode("utf-8", "surrogatepass")
    except (ValueError, RecursionError):
        return text


class Index:
    """Values of a batch of texts as parallel arrays.

    doc, kind, start, end (of the span in buf), parent (index of the container, -1 at the top),
    key (code of the member name, 0: another name, -1: none), pos (place in the list, else 0),
    level (nesting depth). `valid[d]` tells whether text d is JSON; texts that aren't have no values.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, names: list[str]) -> None:
        self.names = names
        n_docs = len(offsets) - 1
        base = int(offsets[0])
        buf = buf[base : int(offsets[-1])]
        offsets = offsets.astype(np.int64) - base
        raw = buf.tobytes()
        if _NESTED.search(raw) or self._quoted(buf, offsets).any():
            buf, offsets = self._opened(raw, offsets)
        self.buf, self.offsets = buf, offsets
        self._index(n_docs)

    @staticmethod
    def _quoted(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the first sign of each text, blanks aside, is a quote."""
        at, end = offsets[:-1].copy(), offsets[1:]
        led = np.flatnonzero((at < end) & _SPACE[buf[np.minimum(at, max(len(buf) - 1, 0))]]) if len(buf) else np.empty(0, np.int64)
        if len(led):
            solid = np.append(np.flatnonzero(~_SPACE[buf]), len(buf))
            at[led] = solid[np.searchsorted(solid, at[led])]
        has = at < end
        out = np.zeros(len(at), bool)
        out[has] = buf[at[has]] == 0x22
        return out

    def _opened(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs = set(np.flatnonzero(self._quoted(np.frombuffer(raw, np.uint8), offsets)).tolist())
        hits = np.fromiter((m.start() for m in _NESTED.finditer(raw)), np.int64)
        docs |= set((np.searchsorted(offsets, hits, "right") - 1).tolist())
        cuts = offsets.tolist()
        texts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        for d in docs:
            texts[d] = open_strings(texts[d])
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def _index(self, n_docs: int) -> None:
        buf, offsets = self.buf, self.offsets
        n = len(buf)
        lengths = np.diff(offsets)
        # Quotes, less those after an odd run of backslashes.
        quote = buf == 0x22
        slash = buf == 0x5C
        if slash.any():
            at = np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
            other = np.where(slash, at.dtype.type(-1), at)
            heads = offsets[:-1][lengths > 0]
            other[heads] = np.maximum(other[heads], heads - 1)  # a run doesn't reach back into another text
            last_other = np.maximum.accumulate(other)
            run = np.zeros(n, at.dtype)
            run[1:] = at[:-1] - last_other[:-1]
            run[heads] = 0
            quote &= run % 2 == 0
            self._escapes = np.flatnonzero(slash & (run % 2 == 0))
        else:
            self._escapes = np.empty(0, np.int64)
        q_pos = np.flatnonzero(quote)
        q_doc = np.searchsorted(offsets, q_pos, "right") - 1
        q_first = np.searchsorted(q_pos, offsets[:-1])  # quotes before each text
        odd = (np.diff(np.concatenate([q_first, [len(q_pos)]])) % 2) == 1
        valid = ~odd & (lengths > 0)
        q_odd = (np.arange(len(q_pos)) - q_first[q_doc]) % 2  # 0: opens, 1: closes
        # Inside strings: +1 after an opening quote, -1 at the closing one; broken texts end at their border.
        step = np.zeros(n + 1, np.int8)
        step[q_pos[q_odd == 0] + 1] += 1
        step[q_pos[q_odd == 1]] -= 1
        broken = np.flatnonzero(odd)
        if len(broken):
            np.subtract.at(step, offsets[broken + 1], 1)
        inside = np.cumsum(step[:n], dtype=np.int8) > 0
        control = (buf < 0x20) & inside
        if control.any():
            valid[np.unique(np.searchsorted(offsets, np.flatnonzero(control), "right") - 1)] = False
        bad = self._bad_escapes(inside)
        if len(bad):
            valid[np.unique(np.searchsorted(offsets, bad, "right") - 1)] = False
        kind = _KIND[buf]
        kind[inside] = 0
        plain = ~inside & (kind == 0) & ~quote & ~_SPACE[buf]
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        starts = plain.copy()
        starts[1:] &= ~plain[:-1] | border[1:n]
        ends = plain.copy()
        ends[:-1] &= ~plain[1:] | border[1:n]
        # Tokens in order of position.
        opens = q_pos[q_odd == 0]
        mark = kind
        mark[opens] = _QUOTE
        mark[np.flatnonzero(starts)] = _PRIM
        pos = np.flatnonzero(mark)
        tok = mark[pos]
        doc = np.searchsorted(offsets, pos, "right") - 1
        end = pos + 1
        closing = q_pos[q_odd == 1]
        is_q = tok == _QUOTE
        m = min(len(closing), int(is_q.sum()))
        if m:
            nxt = np.searchsorted(closing, pos[is_q])
            end[is_q] = closing[np.minimum(nxt, len(closing) - 1)]  # before the closing quote
        is_p = tok == _PRIM
        end[is_p] = np.flatnonzero(ends) + 1
        start = np.where(is_q, pos + 1, pos)
        # Depth before each token within its text.
        opener = (tok == _OPEN_OBJ) | (tok == _OPEN_ARR)
        closer = (tok == _CLOSE_OBJ) | (tok == _CLOSE_ARR)
        delta = opener.astype(np.int64) - closer
        run = np.cumsum(delta)
        t_first = np.searchsorted(doc, np.arange(n_docs))
        t_count = np.diff(np.concatenate([t_first, [len(tok)]]))
        before = np.concatenate([[0], run])[t_first]
        level = run - delta - before[doc] - closer  # openers, closers and members: the level they stand on
        if len(tok):
            low = np.full(n_docs, 0, np.int64)
            np.minimum.at(low, doc, level)
            total = np.zeros(n_docs, np.int64)
            np.add.at(total, doc, delta)
            valid &= (low >= 0) & (total == 0)
        valid &= t_count > 0
        # The container of each token: the last opener one level up before it.
        parent = np.full(len(tok), -1, np.int64)
        ok = valid[doc]
        order = np.flatnonzero(ok)
        order = order[np.argsort(level[order], kind="stable")]
        lv = level[order]
        cuts = np.searchsorted(lv, np.arange(int(lv[-1]) + 2)) if len(lv) else np.zeros(1, int)
        up = np.empty(0, np.int64)
        for k in range(len(cuts) - 1):
            here = order[cuts[k] : cuts[k + 1]]
            if k and len(here):
                parent[here] = up[np.searchsorted(up, here) - 1] if len(up) else -1
            up = here[opener[here]]
        held_by = np.zeros(len(tok), np.int8)  # 0: the top
        in_any = parent >= 0
        held_by[in_any] = tok[parent[in_any]]
        # What came right before each token of the same text.
        prev = np.concatenate([[0], tok[:-1]]) if len(tok) else tok
        prev = prev.copy()
        prev[t_first[t_count > 0]] = 0
        in_obj, in_arr, top = held_by == _OPEN_OBJ, held_by == _OPEN_ARR, held_by == 0
        is_key = (tok == _QUOTE) & in_obj & ((prev == _OPEN_OBJ) | (prev == _COMMA))
        prev_key = np.concatenate([[False], is_key[:-1]]) if len(tok) else is_key
        value = (opener | is_q | is_p) & ~is_key
        done = np.isin(prev, (_CLOSE_OBJ, _CLOSE_ARR, _PRIM)) | ((prev == _QUOTE) & ~prev_key)
        grammar = np.where(
            value, (top & (prev == 0)) | (in_obj & (prev == _COLON)) | (in_arr & ((prev == _OPEN_ARR) | (prev == _COMMA))),
            np.where(is_key, True, np.where(
                tok == _COLON, in_obj & (prev == _QUOTE) & prev_key,
                np.where(tok == _COMMA, ~top & done, np.where(
                    tok == _CLOSE_OBJ, done | (prev == _OPEN_OBJ), done | (prev == _OPEN_ARR))))))
        # Closers must match their opener: the opener of their level.
        ci = np.flatnonzero(closer & ok)
        if len(ci):
            grammar[ci] &= self._matches(order, cuts, opener, tok, level, ci)
        # Primitives: a number's characters or a literal.
        pi = np.flatnonzero(is_p & ok)
        if len(pi):
            grammar[pi] &= self._primitives(start[pi], end[pi])
        if not grammar.all():
            valid[np.unique(doc[~grammar & ok])] = False
        # Members keep the code of their name; list items their place.
        keep = value & valid[doc]
        vi = np.flatnonzero(keep)
        code = np.full(len(tok), -1, np.int16)
        ki = np.flatnonzero(is_key & valid[doc])
        code[ki] = self._codes(start[ki], end[ki])
        key = np.full(len(vi), -1, np.int16)
        member = in_obj[vi]
        key[member] = code[vi[member] - 2]
        commas = np.cumsum(tok == _COMMA)
        place = np.zeros(len(vi), np.int64)
        item = np.flatnonzero(in_arr[vi])
        if len(item):
            place[item] = self._places(vi[item], parent, tok, commas, level)
        back = np.full(len(tok), -1, np.int64)
        back[vi] = np.arange(len(vi))
        self.valid = valid
        self.doc, self.start, self.end, self.level = doc[vi], start[vi], end[vi], level[vi]
        self.kind = np.select([tok[vi] == _OPEN_OBJ, tok[vi] == _OPEN_ARR, tok[vi] == _QUOTE], [OBJECT, ARRAY, STRING], PRIMITIVE).astype(np.int8)
        self.parent = np.where(parent[vi] >= 0, back[parent[vi]], -1)
        self.key, self.pos = key, place

    def _bad_escapes(self, inside: np.ndarray) -> np.ndarray:
        """Places within strings of escapes that JSON doesn't know."""
        at = self._escapes[inside[self._escapes]]
        tail = np.concatenate([self.buf, np.zeros(6, np.uint8)])
        after = tail[at + 1]
        wrong = ~_ESCAPED[after]
        u = np.flatnonzero(after == 0x75)
        for i in range(2, 6):
            wrong[u] |= ~_HEX[tail[at[u] + i]]
        return at[wrong]

    @staticmethod
    def _matches(order, cuts, opener, tok, level, ci):  # noqa: ANN001, ANN205
        good = np.zeros(len(tok), bool)
        for k in range(len(cuts) - 1):
            here = order[cuts[k] : cuts[k + 1]]
            ups = here[opener[here]]
            cl = here[(tok[here] == _CLOSE_OBJ) | (tok[here] == _CLOSE_ARR)]
            if len(cl) and len(ups):
                at = np.searchsorted(ups, cl) - 1
                good[cl] = (at >= 0) & (tok[ups[np.maximum(at, 0)]] == tok[cl] - 1)
        return good[ci]

    def _primitives(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        bad = np.concatenate([[0], np.cumsum(~_DIGITS[self.buf])])
        number = (bad[e] - bad[s]) == 0
        first = self.buf[s]
        number &= (first == 0x2D) | ((first >= 0x30) & (first <= 0x39))
        last = self.buf[e - 1]
        number &= (last >= 0x30) & (last <= 0x39)
        # Plain digits with at most one inner point need no second look.
        odd_sign = np.concatenate([[0], np.cumsum(np.isin(self.buf, np.frombuffer(b"+-eE", np.uint8)))])
        points = np.concatenate([[0], np.cumsum(self.buf == 0x2E)])
        second = self.buf[np.minimum(s + 1, len(self.buf) - 1)]
        look = number & ((odd_sign[e] > odd_sign[s]) | (points[e] - points[s] > 1) | ((first == 0x30) & (e - s > 1) & (second != 0x2E)))
        for j in np.flatnonzero(look):
            number[j] = _NUMBER.fullmatch(self.buf[s[j] : e[j]].tobytes()) is not None
        for word in (b"true", b"false", b"null"):
            number |= self._equal(s, e, word)
        return number

    def _equal(self, s: np.ndarray, e: np.ndarray, word: bytes) -> np.ndarray:
        hit = (e - s) == len(word)
        at = np.flatnonzero(hit)
        for i, c in enumerate(word):
            if not len(at):
                break
            at = at[self.buf[s[at] + i] == c]
        out = np.zeros(len(s), bool)
        out[at] = True
        return out

    def _codes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        code = np.zeros(len(s), np.int16)
        for i, name in enumerate(self.names):
            code[self._equal(s, e, name.encode())] = i + 1
        slashes = np.concatenate([[0], np.cumsum(self.buf == 0x5C)])
        for j in np.flatnonzero(slashes[e] > slashes[s]):  # names spelled with escapes
            name = self._text(s[j], e[j])
            if name in self.names:
                code[j] = self.names.index(name) + 1
        return code

    @staticmethod
    def _places(items, parent, tok, commas, level):  # noqa: ANN001, ANN205
        """Commas on the items' own level between their list's opening and them."""
        comma = np.flatnonzero(tok == _COMMA)
        owner = parent[comma]
        o = np.argsort(owner, kind="stable")
        comma, owner = comma[o], owner[o]
        first = np.searchsorted(owner, parent[items])
        # Commas of one owner are sorted; those before the item count.
        both = owner.astype(np.int64) * (len(tok) + 1) + comma
        return np.searchsorted(both, parent[items] * (len(tok) + 1) + items) - first

    def _text(self, s: int, e: int) -> str:
        raw = self.buf[s:e].tobytes()
        if b"\\" in raw:
            try:
                return json.loads(b'"' + raw + b'"')
            except ValueError:
                return raw.decode("utf-8", "replace")
        return raw.decode("utf-8", "replace")

    def text(self, node: int) -> str | None:
        """A scalar as text; null for JSON's null."""
        t = self._text(self.start[node], self.end[node])
        return None if self.kind[node] == PRIMITIVE and t == "null" else t

    # -- steps over many values at once --

    def child(self, code: int) -> np.ndarray:
        """For each value its member of that name, or -1."""
        out = np.full(len(self.doc), -1, np.int64)
        m = np.flatnonzero(self.key == code)
        out[self.parent[m]] = m
        return out

    def below(self, code: int, stop: tuple[int, ...]) -> np.ndarray:
        """As child, also through members that are objects (wrappers), not through lists nor members named in stop."""
        found = self.child(code)
        has = found >= 0
        objs = np.flatnonzero((self.kind == OBJECT) & (self.key >= 0) & ~np.isin(self.key, stop))
        for lv in range(int(self.level.max(initial=0)), 0, -1):
            w = objs[self.level[objs] == lv]
            w = w[(found[w] >= 0) & ~has[self.parent[w]]][::-1]  # of several wrappers the first
            found[self.parent[w]] = found[w]
        return found

    def elements(self, roots: np.ndarray, is_item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The objects a value stands for: (index into roots, value, place).

        A list gives its elements. An object that is an item gives itself at place 0; another one is
        a wrapper: its lists count, else its objects. Anything else gives nothing.
        """
        outs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_parent = np.argsort(self.parent, kind="stable")
        sorted_parent = self.parent[by_parent]

        def children(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = np.searchsorted(sorted_parent, of), np.searchsorted(sorted_parent, of, "right")
            counts = b - a
            which = np.repeat(np.arange(len(of)), counts)
            flat = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(a, counts)
            return which, by_parent[flat]

        who, at = np.arange(len(roots)), roots
        while len(at):
            arr = self.kind[at] == ARRAY
            which, kids = children(at[arr])
            outs.append((who[arr][which], kids, self.pos[kids]))
            obj = self.kind[at] == OBJECT
            item = obj & is_item[at]
            outs.append((who[item], at[item], np.zeros(int(item.sum()), np.int64)))
            wrap = obj & ~is_item[at]
            which, kids = children(at[wrap])
            listed = self.kind[kids] == ARRAY
            any_list = np.zeros(int(wrap.sum()), bool)
            any_list[which[listed]] = True
            go = listed | ((self.kind[kids] == OBJECT) & ~any_list[which])
            who, at = who[wrap][which[go]], kids[go]
        cat = [np.concatenate(x) for x in zip(*outs)] if outs else [np.empty(0, np.int64)] * 3
        return cat[0], cat[1], cat[2]
