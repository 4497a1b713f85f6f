"""Cross-tokenizer alignment: which tokens of two vocabularies lie on the same bytes.

Each text is encoded twice.  Where both tokenizers end a token the text is cut into
groups, and every pair of tokens that shares a byte is a link.  For each pair of ids an
inverted list says in which documents it is linked: one bitmap for each block of
documents, in planes (plane p holds the documents whose number of links has bit p), each
as short slots or as bits, whichever is smaller.  Merged planes give, by their set bits,
the documents and links of a pair; those scores go back along the same lists.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.blocks import SLOTS, numbered_blocks, shuffles_end
from scorewright.llm.common import even, written

TOKENIZERS = "/opt/tokenizers"
FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
# Bytes of text that are encoded and cut together.
SLICE = 500_000
# Ids of the second vocabulary have to be below this.
IDS = 1 << 20
# From this many slots on a container is a bitmap.
DENSE = SLOTS // 16
_WIDE = re.compile("[^\x00-ɏ]")
# Fixed value: how the first vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, first: bytes, second: bytes):
        import sentencepiece
        import tiktoken

        self.source = first.decode("utf-8")
        model = json.loads(self.source)["model"]
        letters = _byte_letters()
        self.a_bytes = [b""] * (1 + max(model["vocab"].values()))
        ranks = {}
        for token, i in model["vocab"].items():
            if all(c in letters for c in token):
                self.a_bytes[i] = bytes(letters[c] for c in token)
                ranks[self.a_bytes[i]] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        # Merges in the order of their ids are what the faster encoder needs.
        ordered = ids == sorted(ids) and len(ids) + 256 == len(ranks)
        self.fast = ordered and tiktoken.Encoding(
            "first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.slow = None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:-1], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(b"")
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode("utf-8"))
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)

    def first(self, text: str) -> list[int]:
        """Ids of the first vocabulary.

        Beyond Latin letters, classes of characters depend on the edition of Unicode a
        library has; there the library of the vocabulary's own format is asked.
        """
        if self.fast and not _WIDE.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.source)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none where a text is empty or a tokenizer does not give its bytes back."""
        a_ids, b_ids = [], []
        seconds = self.b.encode([t or "" for t in texts], num_threads=1)
        for text, second in zip(texts, seconds):
            first = self.first(" " + text) if text else []
            whole = (" " + text).encode("utf-8") if text else b""
            same = (
                whole == b"".join(map(self.a_bytes.__getitem__, first))
                and whole == b"".join(map(self.b_bytes.__getitem__, second))
                and all(map(self.b_bytes.__getitem__, second))
            )
            a_ids.append(first if same else [])
            b_ids.append(second if same else [])
        return a_ids, b_ids


def _names(size: int) -> list[str]:
    """Decimal ids, followed by each of the three separators in turn."""
    return [f"{i}{end}" for end in ",|;" for i in range(size)]


def cut(a_ids: list[list[int]], b_ids: list[list[int]], pair: Pair, names: list[str]) -> dict:
    """Groups and links of some documents.

    Both token sequences run over the same bytes, so the pieces between all token ends
    are the links: each lies in one token of either side.
    """
    size = len(names) // 3
    sizes_a = np.array([len(x) for x in a_ids], dtype=np.int64)
    sizes_b = np.array([len(x) for x in b_ids], dtype=np.int64)
    a = np.fromiter(chain.from_iterable(a_ids), np.int64, sizes_a.sum())
    b = np.fromiter(chain.from_iterable(b_ids), np.int64, sizes_b.sum())
    a_ends, b_ends = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    edge = np.zeros(1 + (a_ends[-1] if len(a) else 0), dtype=np.int8)
    edge[a_ends] += 1
    edge[b_ends] += 2
    ends = np.flatnonzero(edge)
    kinds = edge[ends]
    # The token of either side that each piece lies in.
    at_a = np.cumsum(kinds & 1) - (kinds & 1)
    at_b = np.cumsum(kinds >> 1) - (kinds >> 1)
    both = kinds == 3
    text_ends = np.concatenate([[0], np.cumsum(np.bincount(
        np.repeat(np.arange(len(a_ids)), sizes_a), pair.a_size[a], len(a_ids)
    ).astype(np.int64))])
    upto = np.searchsorted(ends, text_ends, "right")
    groups_upto = np.concatenate([[0], np.cumsum(both)])[upto]
    # Tokens in the order of the written groups, each with what follows it.
    group = np.cumsum(both) - both
    group_a = group[np.flatnonzero(kinds & 1)]
    group_b = group[np.flatnonzero(kinds >> 1)]
    place = np.concatenate([2 * group_a, 2 * group_b + 1])
    order = np.argsort(place, kind="stable")
    ids, place = np.concatenate([a, b])[order], place[order]
    after = np.zeros(len(ids), dtype=np.int64)
    last = np.flatnonzero(np.r_[place[1:] != place[:-1], True]) if len(ids) else []
    after[last] = 1 + (place[last] & 1)
    written_ids = list(map(names.__getitem__, (after * size + ids).tolist()))
    starts = np.concatenate([[0], np.cumsum(sizes_a + sizes_b)]).tolist()
    return {
        "n_a": sizes_a,
        "n_b": sizes_b,
        "n_links": np.diff(upto),
        "n_groups": np.diff(groups_upto),
        "groups": ["".join(written_ids[x:y])[:-1] for x, y in zip(starts, starts[1:])],
        "pairs": a[at_a] * IDS + b[at_b],
        "docs": np.repeat(np.arange(len(a_ids)), np.diff(upto)),
    }


def containers(pairs: np.ndarray, slots: np.ndarray, times: np.ndarray) -> tuple:
    """Distinct pairs, their number of planes, and the containers of all planes in order.

    Takes distinct (pair, slot) sorted by pair and slot, and their number of links.
    """
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.array([], int)
    index = np.cumsum(np.r_[False, pairs[1:] != pairs[:-1]]) if len(pairs) else first
    most = np.maximum.reduceat(times, first) if len(pairs) else first
    planes = np.ceil(np.log2(most + 1)).astype(np.int64)
    base = np.cumsum(planes) - planes
    box, inside = [], []
    for p in range(int(planes.max(initial=0))):
        some = np.flatnonzero((times >> p) & 1)
        box.append(base[index[some]] + p)
        inside.append(slots[some])
    box, inside = (np.concatenate([*x, []]).astype(np.int64) for x in (box, inside))
    order = np.argsort(box, kind="stable")
    box, inside = box[order], inside[order]
    held = np.bincount(box, minlength=int(planes.sum()))
    sizes = np.where(held < DENSE, 2 * held, SLOTS // 8)
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), dtype=np.uint8)
    dense = held[box] >= DENSE
    rank = np.arange(len(box)) - np.repeat(np.cumsum(held) - held, held)
    spot = starts[box] + 2 * rank
    data[spot[~dense]] = inside[~dense] & 255
    data[spot[~dense] + 1] = inside[~dense] >> 8
    bits = (1 << (inside[dense] & 7)).astype(np.uint8)
    np.bitwise_or.at(data, starts[box[dense]] + (inside[dense] >> 3), bits)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    cells = pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )
    return pairs[first], planes, cells


def opened(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, plane and slot of every set bit of a column of planes."""
    offsets = column.offsets.to_numpy()
    cells = column.values
    if pa.types.is_large_binary(cells.type):
        cells = cells.cast(pa.binary())
    held = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)
    planes = np.diff(offsets)
    box = np.arange(offsets[0], offsets[-1])
    row = np.repeat(np.arange(len(planes)), planes)
    plane = np.arange(len(box)) - np.repeat(np.cumsum(planes) - planes, planes)
    starts, sizes = held[box].astype(np.int64), np.diff(held)[box].astype(np.int64)
    dense = sizes == SLOTS // 8
    short = np.where(dense, 0, sizes // 2)
    which = np.repeat(np.arange(len(box)), short)
    spot = starts[which] + 2 * (np.arange(len(which)) - np.repeat(np.cumsum(short) - short, short))
    slots = data[spot].astype(np.int64) | data[spot + 1].astype(np.int64) << 8
    full = np.flatnonzero(dense)
    bits = np.unpackbits(
        data[starts[full][:, None] + np.arange(SLOTS // 8)], axis=1, bitorder="little"
    )
    which_full, slots_full = np.nonzero(bits)
    which = np.concatenate([which, full[which_full]])
    return row[which], plane[which], np.concatenate([slots, slots_full])


def _encoded(docs: DataFrame, first: bytes, second: bytes, digest: bool) -> DataFrame:
    """Documents with their groups, and the planes of each block, in one written table."""
    files = docs.sparkSession.sparkContext.broadcast((first, second))
    kind = docs.schema[0].dataType.simpleString()
    schema = (
        f"block long, slot int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long,"
        " groups string, pair long, planes array<binary>"
    )
    names_of = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches):
        pair = Pair(*files.value)
        names = _names(max(len(pair.a_bytes), len(pair.b_bytes)))
        for block, ids, texts in numbered_blocks(batches):
            parts, keys, at = [], [], 0
            while at < len(texts):
                size, upto = 0, at
                while upto < len(texts) and (size == 0 or size < SLICE):
                    size += len(texts[upto] or "")
                    upto += 1
                part = cut(*pair.encode(texts[at:upto]), pair, names)
                # A slice's pairs are merged as they come: (pair, slot) and how often.
                keys.append(np.unique(part.pop("pairs") * SLOTS + part.pop("docs") + at, return_counts=True))
                parts.append(part)
                at = upto
            none = pa.nulls(len(texts))
            groups = [g for part in parts for g in part["groups"]]
            if digest:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": np.full(len(texts), block),
                    "slot": np.arange(len(texts), dtype=np.int32),
                    "doc_id": ids.combine_chunks(),
                    **{c: np.concatenate([p[c] for p in parts]).astype(np.int64) for c in names_of},
                    "groups": pa.array(groups, pa.string()),
                    "pair": none.cast(pa.int64()),
                    "planes": none.cast(pa.list_(pa.binary())),
                }
            )
            key, times = (np.concatenate([k[i] for k in keys]) for i in range(2))
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            distinct, planes, cells = containers(key // SLOTS, key % SLOTS, times)
            ends = np.concatenate([[0], np.cumsum(planes)]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), cells)
            for low in range(0, len(distinct), 50_000):
                some = distinct[low : low + 50_000]
                none = pa.nulls(len(some))
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": np.full(len(some), block),
                        "slot": none.cast(pa.int32()),
                        "doc_id": none.cast(ids.type),
                        **{c: none.cast(pa.int64()) for c in names_of},
                        "groups": none.cast(pa.string()),
                        "pair": some,
                        "planes": held.slice(low, len(some)),
                    }
                )

    return written(docs.mapInArrow(run, schema), "aligned")


def pair_counts(postings: DataFrame) -> DataFrame:
    """``pair, n_docs, n_links`` from the planes of all blocks."""

    def run(batches):
        for batch in batches:
            column = batch.column("planes")
            row, plane, slot = opened(column)
            # Documents are the set bits of all planes laid over each other.
            merged = np.unique(row * SLOTS + slot) // SLOTS
            links = np.zeros(len(batch), dtype=np.int64)
            np.add.at(links, row, np.int64(1) << plane)
            yield pa.RecordBatch.from_pydict(
                {
                    "pair": batch.column("pair"),
                    "n_docs": np.bincount(merged, minlength=len(batch)),
                    "n_links": links,
                }
            )

    rows = postings.select("pair", "planes").mapInArrow(run, "pair long, n_docs long, n_links long")
    return rows.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def align(
    docs: DataFrame,
    tokenizers: str = TOKENIZERS,
    key: str = "doc_id",
    text: str = "text",
    digest: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Alignments of all documents, and the pairs of ids with their scores.

    The first has ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``, one
    row for each row of ``docs``; ``groups`` is ``a1,a2|b1;a3|b2,b3``, or its SHA-256.
    The second has ``a, b, n_docs, n_links, best``: best pairs have the most links of
    their b.  Null and empty texts, and those a tokenizer does not give back byte by
    byte, have no tokens: zeros and ''.  Repeated rows are documents of their own and
    count as often as they occur; null ids are kept; extra columns are left out.  Long
    texts are encoded whole.
    """
    with open(os.path.join(tokenizers, FIRST), "rb") as one, open(os.path.join(tokenizers, SECOND), "rb") as two:
        first, second = one.read(), two.read()
    scan = even(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    encoded = _encoded(scan, first, second, digest)
    postings = encoded.filter("pair is not null").select("block", "pair", "planes")
    b = F.col("pair").bitwiseAND(F.lit(IDS - 1))
    most = Window.partitionBy(b)
    counts = pair_counts(postings).withColumn("best", F.col("n_links") == F.max("n_links").over(most))
    with shuffles_end(docs.sparkSession):
        counts = written(counts, "pairs")
    # Pairs grow with the corpus, so they are never broadcast, at whatever size.
    scored = postings.join(counts.select("pair", "n_links", "best").hint("merge"), "pair")
    scored = scored.select(F.col("block").alias("home"), "planes", "n_links", "best")

    def returned(left: pa.Table, right: pa.Table) -> pa.Table:
        total, best = np.zeros(SLOTS, dtype=np.int64), np.zeros(SLOTS, dtype=np.int64)
        for batch in right.to_batches():
            row, plane, slot = opened(batch.column("planes"))
            times = np.int64(1) << plane
            links = batch.column("n_links").to_numpy(zero_copy_only=False)
            of_best = batch.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(total, slot, times * links[row])
            np.add.at(best, slot, times * of_best[row])
        slot = left.column("slot").to_numpy()
        result = left.drop_columns(["block", "slot"])
        return result.append_column("n_best", pa.array(best[slot])).append_column(
            "count_sum", pa.array(total[slot])
        )

    documents = encoded.filter("pair is null").drop("pair", "planes")
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string,"
        " n_best long, count_sum long"
    )
    met = documents.groupBy("block").cogroup(scored.groupBy("home"))
    a = F.shiftright("pair", IDS.bit_length() - 1)
    return met.applyInArrow(returned, schema), counts.select(
        a.cast("int").alias("a"), b.cast("int").alias("b"), "n_docs", "n_links", "best"
    )
