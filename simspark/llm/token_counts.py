"""Edit-aware token counts.

Each document keeps a tree over its pre-tokens: a leaf holds LEAF pre-tokens, a node the characters, tokens and pre-tokens below
it. An edit re-splits the text from the last leaf that starts MARGIN characters before it, as far as a leaf behind it whose start is
a pre-token boundary again; only the pre-tokens in between are encoded anew, and the sums on the paths to the root are
updated. The rest of the document is never encoded again. Trees are rows, saved and edited again later.

Cases: null and empty texts are trees without leaves and can be edited like others; edits beyond the end are cut to it and those
whose stop lies before their start insert; a null edit, or one without text, is nothing or a deletion; edits apply in their order,
each to the text that the ones before have left; very long texts are used whole; rows that repeat give equal rows; an empty table
gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simspark.llm.common import Workspace, slices, table
from simspark.llm.pretoken import MARGIN, encoder, split_texts

#: Pre-tokens of a leaf, and how many times as many it may come to hold before the tree is given more leaves.
LEAF, FULL = 8, 4
COUNTS = ["n_tokens", "n_tokens_edited", "n_chars_edited", "n_pieces_edited", "n_reencoded"]
_BYTES, _ROWS = 2_000_000, 200
_PATTERN = regex.compile(public_tokenizers.PATTERN)


class PieceCounts(dict):
    """Tokens of a pre-token, encoded on first use and kept up to a bound."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        if len(self) > 150_000:
            self.clear()
        n = self[piece] = len(self.encoding._encode_single_piece(piece))
        return n


class CountTree:
    """Sums of (characters, tokens, pre-tokens) over the leaves of one text, in heap order."""

    def __init__(self, texts: list[str], tokens: list[int], pieces: list[int], counts: PieceCounts):
        self.texts, self.counts, self.reencoded = texts, counts, 0
        self.size = 1 << max(0, len(texts) - 1).bit_length()
        self.sums = []
        for values in ([len(t) for t in texts], tokens, pieces):
            heap = [0] * self.size + values + [0] * (self.size - len(values))
            for i in range(self.size - 1, 0, -1):
                heap[i] = heap[2 * i] + heap[2 * i + 1]
            self.sums.append(heap)

    @classmethod
    def of(cls, text: str, counts: PieceCounts) -> CountTree:
        found = _PATTERN.findall(text)
        leaves = [found[i : i + LEAF] for i in range(0, len(found), LEAF)]
        return cls(["".join(x) for x in leaves], [sum(map(counts.__getitem__, x)) for x in leaves], [len(x) for x in leaves], counts)

    @property
    def total(self) -> tuple[int, int, int]:
        return tuple(s[1] for s in self.sums)

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf, its start) of the character at `at`; the last leaf for the end of the text."""
        chars, node, start = self.sums[0], 1, 0
        while node < self.size:
            node *= 2
            if at >= start + chars[node] and chars[node + 1]:
                start += chars[node]
                node += 1
        return node - self.size, start

    def _put(self, leaf: int, text: str, tokens: int, pieces: int) -> None:
        self.texts[leaf] = text
        for heap, value in zip(self.sums, (len(text), tokens, pieces)):
            node = leaf + self.size
            heap[node] = value
            while node > 1:
                node //= 2
                heap[node] = heap[2 * node] + heap[2 * node + 1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters [start, stop) by `new`."""
        n = self.sums[0][1]
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        if not self.texts:
            self.__init__([""], [0], [0], self.counts)
        first, begin = self._leaf(max(0, start - MARGIN))
        # the leaf's start is a boundary that shows MARGIN characters before the edit, or the text's start
        last, _ = self._leaf(stop)
        head = "".join(self.texts[first : last + 1])
        text = head[: start - begin] + new + head[stop - begin :]
        edges, more = [(last, len(text))], 1  # leaves that the region may end with, and where in the text they end
        while True:
            found = [(m.start(), m.end()) for m in _PATTERN.finditer(text)]
            starts, done = {a for a, _ in found}, edges[-1][0] + 1 >= len(self.texts)
            # the region ends where the leaf behind it starts with a boundary; the last edge shows nothing behind it
            for leaf, edge in edges if done else edges[:-1]:
                if edge == len(text) and done or edge in starts and edge + MARGIN <= len(text) and edge >= start + len(new) - begin:
                    break
            else:
                for leaf in range(edges[-1][0] + 1, min(edges[-1][0] + 1 + more, len(self.texts))):
                    text += self.texts[leaf]
                    edges.append((leaf, len(text)))
                more *= 2
                continue
            break
        self._replace(first, leaf, [text[a:b] for a, b in found if b <= edge])

    def _replace(self, first: int, last: int, pieces: list[str]) -> None:
        """Put pieces, encoded anew, into the leaves first to last; where they would grow too full, the tree gets more leaves."""
        self.reencoded += len(pieces)
        slots = last - first + 1
        each = max(LEAF, -(-len(pieces) // slots))
        grown = each > FULL * LEAF
        parts = [pieces[i : i + (LEAF if grown else each)] for i in range(0, len(pieces), LEAF if grown else each)]
        leaves = [("".join(p), sum(map(self.counts.__getitem__, p)), len(p)) for p in parts]
        if grown:
            old = [heap[self.size : self.size + len(self.texts)] for heap in self.sums]
            texts = self.texts[:first] + [x[0] for x in leaves] + self.texts[last + 1 :]
            tokens, counts = (old[k][:first] + [x[k] for x in leaves] + old[k][last + 1 :] for k in (1, 2))
            done = self.reencoded
            self.__init__(texts, tokens, counts, self.counts)
            self.reencoded = done
            return
        for i in range(slots):
            leaf = leaves[i] if i < len(leaves) else ("", 0, 0)
            if leaf[0] or self.texts[first + i]:
                self._put(first + i, *leaf)


TREE = "leaves array<string>, tokens array<int>, pieces array<int>"


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(len(v) for v in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for v in values for x in v], kind))


def count_trees(df: DataFrame, keep: list[str], text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """The columns `keep` of df with the tree of each whole text: its leaves, and the tokens and pre-tokens of each. Save it to edit it later."""
    # columns go by number, as any name may be taken
    rows = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks_path)
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                starts = split_texts(codes, offsets)
                _, at = code.pieces(codes, starts, np.append(starts[1:], len(codes)))
                tokens, cut = np.diff(at), np.searchsorted(starts, offsets)
                out: list[list[list]] = [[], [], []]
                for i, text in enumerate(texts):
                    a, b = cut[i], cut[i + 1]
                    lead = np.arange(0, b - a, LEAF)
                    edge = [*(starts[a:b][lead] - offsets[i]).tolist(), len(text)]
                    out[0].append([text[x:y] for x, y in zip(edge, edge[1:])])
                    out[1].append(np.add.reduceat(tokens[a:b], lead).tolist() if b > a else [])
                    out[2].append(np.diff(np.append(lead, b - a)).tolist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(_lists(x, k) for x, k in zip(out, (pa.string(), pa.int32(), pa.int32())))], [*batch.schema.names[:-1], "leaves", "tokens", "pieces"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    made = rows.mapInArrow(run, ", ".join([*kinds, TREE]))
    return made.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "leaves", "tokens", "pieces")


def edit_trees(trees: DataFrame, edits: str = "edits", id_col: str = "doc_id", ranks_path: str | None = None) -> DataFrame:
    """(doc_id, leaves, tokens, pieces, n_tokens, n_tokens_edited, n_chars_edited, n_pieces_edited, n_reencoded) of trees with
    edits array<struct<start, stop, text>>: the trees after the edits, ready for more, with the counts before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(encoder(ranks_path).encoding)
        for whole in batches:
            for k in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(k, _ROWS)
                out, shape = [], ([], [], [])
                for leaves, tokens, pieces, edits_ in zip(*(batch.column(c).to_pylist() for c in ("leaves", "tokens", "pieces", "edits"))):
                    tree = CountTree(leaves, tokens, pieces, counts)
                    before = tree.total[1]
                    for e in edits_ or ():
                        if e is not None and e["start"] is not None:
                            tree.edit(e["start"], e["start"] if e["stop"] is None else e["stop"], e["text"] or "")
                    chars, after, n = tree.total
                    out.append((before, after, chars, n, tree.reencoded))
                    shape[0].append(tree.texts)
                    for values, heap in zip(shape[1:], tree.sums[1:]):
                        values.append(heap[tree.size : tree.size + len(tree.texts)])
                lists = [_lists(x, kind) for x, kind in zip(shape, (pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, *(pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5))], ["doc_id", "leaves", "tokens", "pieces", *COUNTS])

    kind = trees.schema[id_col].dataType.simpleString()
    rows = trees.select(F.col(id_col).alias("doc_id"), "leaves", "tokens", "pieces", F.col(edits).alias("edits"))
    return rows.mapInArrow(run, f"doc_id {kind}, {TREE}, " + ", ".join(f"{c} long" for c in COUNTS))


def edited_counts(df: DataFrame, edits: str = "edits", id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_pieces_edited, n_reencoded) of rows with edits: the trees are made and saved
    first, and edited from what was saved."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(edits).alias("edits"))
    trees = Workspace(df.sparkSession, "op3").save(count_trees(rows, ["doc_id", "edits"], ranks_path=ranks_path), "trees")
    return edit_trees(trees, ranks_path=ranks_path).select("doc_id", *COUNTS)


def sample_edits(text: Column) -> Column:
    """An insertion in the middle, a deletion at a quarter and a replacement at three quarters of each text."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    at = lambda share: F.floor(n * share).cast("long")
    one = lambda a, size, new: F.struct(a.alias("start"), (a + size).alias("stop"), F.lit(new).alias("text"))
    return F.array(one(at(0.5), 0, " [edited] "), one(at(0.25), 5, ""), one(at(0.75), 3, "\n\n1,024's "))


def op3_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return edited_counts(docs.select("doc_id", "text", sample_edits(F.col("text")).alias("edits")))
