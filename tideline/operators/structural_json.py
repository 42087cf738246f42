"""Vectorised structural indexing of JSON texts, and nested lists as flat linked tables.

Many JSON texts are laid end to end in one byte buffer and indexed together with numpy: bitmaps
of quotes, brackets and delimiters; quote parity and nesting depth by prefix sums; one sort by
(depth, position) that puts the members of every container next to each other, from which parent,
ordinal and key of every value follow. No text is parsed character by character. The result is a
node table: each value with its parent, its place among its siblings, its key and its span.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are indexed at once; bounds the temporary bitmaps. A longer text is indexed alone.
SLICE_BYTES = 2 << 20

QUOTE, BACKSLASH, OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA = (ord(c) for c in '"\\{}[]:,')
STRING, ATOM = 1, 2
_ATOM = re.compile(rb"(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\Z")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_STRUCT = np.zeros(256, bool)
_STRUCT[[OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA]] = True


class StructuralIndex:
    """Node table of a list of JSON texts (bytes).

    Arrays over nodes: ``doc``, ``parent`` (node, or -1), ``ordinal`` (place in the parent, from 0),
    ``kind`` (``{``, ``[``, STRING or ATOM), ``start``/``end`` (span in ``buf``), ``key_start``/``key_end``
    (span inside the quotes of its key, or -1). ``complete`` tells of each text whether it is one
    complete JSON value; other texts have no nodes.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.buf = buf = np.frombuffer(b"".join(texts), np.uint8)
        self.raw = buf.tobytes()
        n_docs = len(texts)
        base = np.zeros(n_docs + 1, np.int64)
        np.cumsum(sizes, out=base[1:])
        pos = np.arange(len(buf))

        # quotes that are not escaped: preceded by an even run of backslashes in their own text
        q = np.flatnonzero(buf == QUOTE)
        q_doc = np.searchsorted(base, q, "right") - 1
        plain = np.maximum.accumulate(np.where(buf != BACKSLASH, pos, -1)) if len(buf) else pos
        run = np.where(q > base[q_doc], q - 1 - plain[np.maximum(q - 1, 0)], 0)
        run = np.minimum(run, q - base[q_doc])
        real = run % 2 == 0
        q, q_doc = q[real], q_doc[real]

        # parity of quotes within a text: where a string opens and closes
        counts = np.bincount(q_doc, minlength=n_docs)
        nth = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        whole = counts % 2 == 0
        keep = whole[q_doc]
        q, q_doc, nth = q[keep], q_doc[keep], nth[keep]
        s_open, s_close = q[nth % 2 == 0], q[nth % 2 == 1]
        mark = np.zeros(len(buf) + 1, np.int8)
        mark[s_open] += 1
        mark[s_close + 1] -= 1
        quoted = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)

        # delimiters and atoms outside of strings
        outside = ~quoted
        structural = _STRUCT[buf] & outside
        solid = outside & ~structural & ~_SPACE[buf]
        first = np.ones(len(buf) + 1, bool)[: len(buf)]
        first[1:] = ~solid[:-1]
        is_base = np.zeros(len(buf) + 1, bool)
        is_base[base[:-1]] = True
        a_start = np.flatnonzero(solid & (first | is_base[:-1]))
        after = np.ones(len(buf), bool)
        after[:-1] = ~solid[1:] | is_base[1:-1]
        a_end = np.flatnonzero(solid & after) + 1

        # tokens in order of position
        t_pos = np.concatenate([np.flatnonzero(structural), s_open, a_start])
        t_kind = np.concatenate([buf[structural], np.full(len(s_open), STRING, np.uint8), np.full(len(a_start), ATOM, np.uint8)])
        t_end = np.concatenate([np.flatnonzero(structural) + 1, s_close + 1, a_end])
        order = np.argsort(t_pos, kind="stable")
        t_pos, t_kind, t_end = t_pos[order], t_kind[order], t_end[order]
        t_doc = np.searchsorted(base, t_pos, "right") - 1
        opener = (t_kind == OPEN_OBJ) | (t_kind == OPEN_ARR)
        closer = (t_kind == CLOSE_OBJ) | (t_kind == CLOSE_ARR)
        depth = np.cumsum(opener.astype(np.int64) - closer)
        n_tok = np.bincount(t_doc, minlength=n_docs)
        at = np.cumsum(n_tok) - n_tok
        before_doc = np.where(at > 0, depth[np.maximum(at - 1, 0)], 0) if len(depth) else np.zeros(n_docs, np.int64)
        depth = depth - before_doc[t_doc]
        ok = whole & (n_tok > 0)
        np.logical_and.at(ok, t_doc, depth >= 0)
        if len(depth):
            ok &= np.where(n_tok > 0, depth[np.maximum(at + n_tok - 1, 0)] == 0, False)

        keep = ok[t_doc]
        t_pos, t_kind, t_end, t_doc, depth, opener, closer = (x[keep] for x in (t_pos, t_kind, t_end, t_doc, depth, opener, closer))
        n = len(t_pos)
        # level: depth of the container a token stands in; an opener stands once in its parent's
        # level as a value and once in its own level as the head; a closer ends its own level
        level = np.where(opener, depth - 1, np.where(closer, depth + 1, depth))
        heads = np.flatnonzero(opener)
        e_tok = np.concatenate([np.arange(n), heads])
        e_level = np.concatenate([level, depth[heads]])
        e_head = np.concatenate([np.zeros(n, bool), np.ones(len(heads), bool)])
        order = np.lexsort((e_tok, e_level, t_doc[e_tok]))
        e_tok, e_head, e_level = e_tok[order], e_head[order], e_level[order]
        e_kind, e_doc = t_kind[e_tok], t_doc[e_tok]
        m = len(e_tok)
        head_at = np.maximum.accumulate(np.where(e_head, np.arange(m), -1)) if m else np.zeros(0, np.int64)
        e_parent = np.where(e_level > 0, e_tok[np.maximum(head_at, 0)], -1)
        comma = e_kind == COMMA
        commas = np.cumsum(comma)
        ordinal = commas - np.where(e_level > 0, commas[np.maximum(head_at, 0)], 0) if m else commas

        # grammar, between neighbours of the same container
        e_close = ((e_kind == CLOSE_OBJ) | (e_kind == CLOSE_ARR)) & ~e_head
        delim = comma | (e_kind == COLON)
        value = ~e_head & ~e_close & ~delim
        prev_kind = np.zeros(m, np.uint8)
        prev_head = np.zeros(m, bool)
        prev_value = np.zeros(m, bool)
        if m:
            prev_kind[1:], prev_head[1:], prev_value[1:] = e_kind[:-1], e_head[:-1], value[:-1]
        in_obj = (e_level > 0) & (t_kind[np.maximum(e_parent, 0)] == OPEN_OBJ) if n else np.zeros(m, bool)
        in_arr = (e_level > 0) & ~in_obj
        prev_comma, prev_colon = (prev_kind == COMMA) & ~prev_head, (prev_kind == COLON) & ~prev_head
        is_key = value & in_obj & (prev_head | prev_comma)
        prev_key = np.zeros(m, bool)
        if m:
            prev_key[1:] = is_key[:-1]
        bad = is_key & (e_kind != STRING)
        bad |= value & in_obj & ~is_key & ~prev_colon
        bad |= (e_kind == COLON) & ~(in_obj & prev_key)
        bad |= comma & ~((in_obj | in_arr) & prev_value & ~prev_key)
        bad |= value & in_arr & ~(prev_head | prev_comma)
        bad |= e_close & ~(prev_head | (prev_value & ~prev_key))
        bad |= e_close & (e_kind == CLOSE_OBJ) & ~in_obj
        bad |= e_close & (e_kind == CLOSE_ARR) & ~in_arr
        root = (e_level == 0) & ~e_head
        bad |= root & ~value
        roots = np.bincount(e_doc[root], minlength=n_docs)
        ok &= roots == 1
        ok[e_doc[bad]] = False
        atoms = np.flatnonzero(value & (e_kind == ATOM))
        legal: dict[bytes, bool] = {}
        for i in atoms:
            x = self.raw[t_pos[e_tok[i]] : t_end[e_tok[i]]]
            good = legal.get(x)
            if good is None:
                good = legal[x] = bool(_ATOM.match(x))
            if not good:
                ok[e_doc[i]] = False

        # nodes: values that are no keys, of complete texts
        node = np.flatnonzero(value & ~is_key & ok[e_doc])
        tok = e_tok[node]
        by_pos = np.argsort(tok, kind="stable")
        node, tok = node[by_pos], tok[by_pos]
        of_tok = np.full(n, -1, np.int64)
        of_tok[tok] = np.arange(len(tok))
        self.doc, self.kind, self.ordinal = e_doc[node], t_kind[tok], ordinal[node]
        self.start, self.end = t_pos[tok], t_end[tok]
        par = e_parent[node]
        self.parent = np.where(par >= 0, of_tok[np.maximum(par, 0)], -1) if n else par
        named = in_obj[node]
        key_tok = e_tok[np.maximum(node - 2, 0)] if m else node
        self.key_start = np.where(named, t_pos[key_tok] + 1, -1) if n else node
        self.key_end = np.where(named, t_end[key_tok] - 1, -1) if n else node
        self.complete = ok
        # a container's span runs to its closer
        boxes = np.flatnonzero((self.kind == OPEN_OBJ) | (self.kind == OPEN_ARR))
        if len(boxes):
            ends = np.full(n, -1, np.int64)
            ends[e_parent[e_close]] = t_end[e_tok[e_close]]
            self.end = self.end.copy()
            self.end[boxes] = ends[tok[boxes]]
        self._children = np.argsort(self.parent, kind="stable")
        self._sorted_parent = self.parent[self._children]

    def roots(self) -> np.ndarray:
        return np.flatnonzero(self.parent == -1)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(children of all nodes, index into ``nodes`` of each child's parent), in order of place."""
        lo = np.searchsorted(self._sorted_parent, nodes, "left")
        hi = np.searchsorted(self._sorted_parent, nodes, "right")
        size = hi - lo
        which = np.repeat(np.arange(len(nodes)), size)
        at = np.repeat(lo, size) + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        return self._children[at], which

    def raw_text(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]

    def string(self, i: int) -> str:
        """The text of a string node, escapes resolved."""
        return _unquote(self.raw[self.start[i] : self.end[i]])

    def key(self, i: int) -> str:
        return _unquote(b'"' + self.raw[self.key_start[i] : self.key_end[i]] + b'"')

    def member(self, nodes: np.ndarray, name: str) -> np.ndarray:
        """Of each object node the value under ``name`` (the last one, if repeated), or -1."""
        found = np.full(len(nodes), -1, np.int64)
        kids, which = self.children(nodes)
        if not len(kids):
            return found
        want = np.frombuffer(name.encode(), np.uint8)
        ks, ke = self.key_start[kids], self.key_end[kids]
        same = np.flatnonzero((ke - ks == len(want)) & (ks >= 0))
        same = same[(self.buf[ks[same][:, None] + np.arange(len(want))] == want).all(axis=1)]
        longer = np.flatnonzero((ks >= 0) & (ke - ks > len(want)))
        escaped = [j for j in longer if b"\\" in self.raw[ks[j] : ke[j]] and self.key(kids[j]) == name]
        hit = np.sort(np.concatenate([same, np.array(escaped, np.int64)])) if escaped else same
        found[which[hit]] = kids[hit]
        return found

    def is_null(self, nodes: np.ndarray) -> np.ndarray:
        return (self.kind[nodes] == ATOM) & (self.buf[self.start[nodes]] == ord("n"))


def _unquote(literal: bytes) -> str:
    if b"\\" not in literal:
        return literal[1:-1].decode("utf-8", "replace")
    return json.loads(literal.decode("utf-8", "replace"), strict=False)


def _clean(text: str) -> bytes:
    return text.removeprefix("\ufeff").encode("utf-8", "surrogatepass")


class _Frame:
    """Nodes of one index with an integer tag row per node."""

    def __init__(self, idx: StructuralIndex, nodes: np.ndarray, tags: np.ndarray):
        self.idx, self.nodes, self.tags = idx, nodes, tags

    def take(self, keep: np.ndarray) -> _Frame:
        return _Frame(self.idx, self.nodes[keep], self.tags[keep])

    def containers(self) -> Iterator[_Frame]:
        """Objects and arrays; a string that holds JSON text counts as what it holds."""
        kind = self.idx.kind[self.nodes]
        yield self.take((kind == OPEN_OBJ) | (kind == OPEN_ARR))
        strings = np.flatnonzero(kind == STRING)
        if len(strings):
            sub = StructuralIndex([_clean(self.idx.string(i)) for i in self.nodes[strings]])
            roots = sub.roots()
            if len(roots):
                yield from _Frame(sub, roots, self.tags[strings][sub.doc[roots]]).containers()

    def members(self, name: str) -> _Frame:
        obj = self.take(self.idx.kind[self.nodes] == OPEN_OBJ)
        got = self.idx.member(obj.nodes, name)
        return _Frame(self.idx, got[got >= 0], obj.tags[got >= 0])

    def items(self) -> Iterator[_Frame]:
        """Elements of arrays, tagged with their place; a lone object is a list of one."""
        kind = self.idx.kind[self.nodes]
        arr, obj = self.take(kind == OPEN_ARR), self.take(kind == OPEN_OBJ)
        kids, which = self.idx.children(arr.nodes)
        yield _Frame(self.idx, kids, np.column_stack([arr.tags[which], self.idx.ordinal[kids]]))
        yield _Frame(self.idx, obj.nodes, np.column_stack([obj.tags, np.zeros(len(obj.nodes), np.int64)]))


def _videos(texts: list[bytes]) -> Iterator[_Frame]:
    """Videos of question files, tagged (text no, video place)."""
    idx = StructuralIndex(texts)
    roots = idx.roots()
    for top in _Frame(idx, roots, idx.doc[roots][:, None]).containers():
        listed = top.idx.member(top.nodes, "videos") if len(top.nodes) else top.nodes
        wrapped = (top.idx.kind[top.nodes] == OPEN_OBJ) & (listed >= 0)
        inner = _Frame(top.idx, listed[wrapped], top.tags[wrapped])
        for holder in [top.take(~wrapped), *inner.containers()]:
            for videos in holder.items():
                yield from videos.containers()


def _questions(texts: list[bytes]) -> Iterator[_Frame]:
    """Question objects of question files, tagged (text no, video place, question place)."""
    for video in _videos(texts):
        for qa in video.members("qa").containers():
            for questions in qa.items():
                for question in questions.containers():
                    yield question.take(question.idx.kind[question.nodes] == OPEN_OBJ)


def _scalar(idx: StructuralIndex, i: int) -> str | None:
    """Text of a scalar as given, or None for null and for objects and arrays."""
    kind = idx.kind[i]
    if kind == STRING:
        return idx.string(i)
    if kind == ATOM and idx.buf[idx.start[i]] != ord("n"):
        return idx.raw_text(i).decode()
    return None


def _qa_rows(texts: list[bytes], file_ids: list[int]) -> Iterator[tuple[str, str, int, str]]:
    """(parent_key, child_kind, child_no, child_key) of questions and options."""
    for f in _questions(texts):
        if not len(f.nodes):
            continue
        ids = [f.idx.member(f.nodes, k) for k in ("question_id", "uid")]
        for j, (t, v, q) in enumerate(f.tags.tolist()):
            name = next((s for m in ids if m[j] >= 0 and (s := _scalar(f.idx, m[j])) is not None), "")
            yield f"{file_ids[t]}:{v}", "question", q, name
        for box in f.members("options").containers():
            idx, kind = box.idx, box.idx.kind[box.nodes]
            kids, which = idx.children(box.nodes)
            place = idx.ordinal[kids].copy()
            lettered = np.flatnonzero(kind[which] == OPEN_OBJ)
            if len(lettered):  # an object: in the order of its letters, the last of a repeated letter
                byparent: dict[int, dict[str, int]] = {}
                for j in lettered:
                    byparent.setdefault(int(which[j]), {})[idx.key(kids[j])] = int(j)
                place[lettered] = -1
                for d in byparent.values():
                    for no, k in enumerate(sorted(d)):
                        place[d[k]] = no
            for i, w, no in zip(kids.tolist(), which.tolist(), place.tolist()):
                if no >= 0 and (s := _scalar(idx, i)) is not None:
                    t, v, q = box.tags[w].tolist()
                    yield f"{file_ids[t]}:{v}:{q}", "option", no, s


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    i = total = 0
    for j, s in enumerate(sizes):
        if total and total + s > SLICE_BYTES:
            yield i, j
            i, total = j, 0
        total += s
    if i < len(sizes):
        yield i, len(sizes)


_LINKS = "src string, parent_key string, child_kind string, child_no bigint, child_key string"


def _qa_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_pylist(), [_clean(x) for x in b.column(1).to_pylist()]
        for i, j in _slices([len(t) for t in texts]):
            rows = list(_qa_rows(texts[i:j], ids[i:j]))
            if rows:
                p, k, n, c = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["qa"] * len(rows)), pa.array(p, pa.string()), pa.array(k, pa.string()), pa.array(n, pa.int64()), pa.array(c, pa.string())],
                    ["src", "parent_key", "child_kind", "child_no", "child_key"],
                )


def question_links(files: DataFrame) -> DataFrame:
    """Questions and options of question files (file_id, payload) as linked rows.

    Null, empty and incomplete payloads and null file ids have no rows. Null elements keep their
    place but have no row. JSON text in a string counts as what it holds.
    """
    return files.select("file_id", "payload").where("file_id is not null and payload is not null").mapInArrow(_qa_batches, _LINKS)


def array_links(df: DataFrame, key: str, lists: dict[str, str], src: str) -> DataFrame:
    """Elements of array columns as linked rows: ``lists`` maps column to child_kind. Null arrays
    and null elements have no row (elements keep their place); rows with a null key have none."""
    # one pass over the table: the lists of a row side by side
    whole = F.array(*(F.struct(F.lit(kind).alias("child_kind"), F.col(column).cast("array<string>").alias("l")) for column, kind in lists.items()))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("parent_key"), F.explode(whole).alias("x"))
    rows = rows.select("parent_key", F.col("x.child_kind").alias("child_kind"), F.posexplode("x.l").alias("no", "child_key")).where("child_key is not null")
    return rows.select(F.lit(src).alias("src"), "parent_key", "child_kind", F.col("no").cast("bigint").alias("child_no"), "child_key")


_NODES = "doc_key string, node_no bigint, parent_no bigint, ordinal bigint, member string, kind string, text string"


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = {OPEN_OBJ: "object", OPEN_ARR: "array", STRING: "string"}
    for b in batches:
        keys, texts = b.column(0).to_pylist(), [_clean(x) for x in b.column(1).to_pylist()]
        for i, j in _slices([len(t) for t in texts]):
            x = StructuralIndex(texts[i:j])
            n = len(x.doc)
            counts = np.bincount(x.doc, minlength=j - i)
            first = (np.cumsum(counts) - counts)[x.doc]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i + d] for d in x.doc], pa.string()),
                    pa.array(np.arange(n) - first),
                    pa.array(np.where(x.parent >= 0, x.parent - first, -1)),
                    pa.array(x.ordinal.astype(np.int64)),
                    pa.array([x.key(k) if x.key_start[k] >= 0 else None for k in range(n)], pa.string()),
                    pa.array([names.get(int(k), "atom") for k in x.kind], pa.string()),
                    pa.array([_scalar(x, k) for k in range(n)], pa.string()),
                ],
                [f.split()[0] for f in _NODES.split(", ")],
            )


def json_nodes(df: DataFrame, key: str, column: str) -> DataFrame:
    """Every value of every complete JSON text in ``column`` as one row that knows its parent
    (``parent_no``, -1 at the root), its place and its member name. Texts that are null or not
    complete JSON have no rows."""
    return (
        df.where(F.col(key).isNotNull() & F.col(column).isNotNull())
        .select(F.col(key).cast("string").alias("doc_key"), F.col(column).alias("text"))
        .mapInArrow(_node_batches, _NODES)
    )
