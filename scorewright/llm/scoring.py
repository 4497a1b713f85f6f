"""Language-model scores of whole texts: a word model, and self-attention on subwords."""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm import attention
from scorewright.llm.attention import CLASSES, OTHER, PAD, SYMBOLS
from scorewright.llm.common import even, worker_value, written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
IDS = 50_257
END = 50_256
# Words counted apart, so that none of them travels with all its texts.
MOST_COMMON = 10_000
# The learnt texts teach the model in so many rounds, each text in one of them.
ROUNDS = 2
# Bytes of text that are worked on together, and for which words are counted in one task.
CHUNK = 3_000_000
BUCKET = 50_000_000
_SEED = 42


def _encoder(folder: str):
    return worker_value(f"subword lines of {folder}", lambda: _read_encoder(folder))


def _read_encoder(folder: str):
    import tiktoken

    with open(os.path.join(folder, VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    # The pattern takes a line whole: only merges of the vocabulary divide it.
    return tiktoken.Encoding(
        "words", pat_str=r"\n|[^\n]+", mergeable_ranks=ranks, special_tokens={}
    )


def subwords(words: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all words, which begin with a blank, and how many each has.

    The empty word is the end.  Words hold no line break, so that one stands between
    them and all are encoded in one call.
    """
    lines, parts = [], np.ones(len(words), dtype=np.int64)
    for i, word in enumerate(words):
        text = " " + word.decode("utf-8", "replace") if word else ""
        if len(text) > 200:
            # Long words in parts, as merging takes the square of the length.
            lines += [text[a : a + 200] for a in range(0, len(text), 200)]
            parts[i] = -(-len(text) // 200)
        else:
            lines.append(text)
    encoder = _encoder(folder)
    ids = encoder.encode_to_numpy("\n".join([*lines, ""])).astype(np.int32)
    ends = np.flatnonzero(ids == encoder.encode_single_token(b"\n"))
    # The break after an empty word is its end; the others go.
    empty = np.diff(ends, prepend=-1) == 1
    ids[ends[empty]] = END
    kept = np.ones(len(ids), dtype=bool)
    kept[ends[~empty]] = False
    line = np.diff(ends, prepend=-1) - ~empty
    many = np.add.reduceat(line, np.cumsum(parts) - parts) if len(words) else line
    return ids[kept], many


class Chunk:
    """Texts worked on together: their tokens as numbers of the distinct words."""

    def __init__(self, texts: list[str | None]):
        tokens: list[bytes] = []
        sizes = []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            tokens += words
            tokens.append(b"")
            sizes.append(len(words) + 1)
        column = np.empty(len(tokens), dtype=object)
        column[:] = tokens
        self.codes, self.words = pd.factorize(column)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.texts = np.repeat(np.arange(len(texts)), self.sizes)

    def pieces(self, folder: str) -> tuple[np.ndarray, np.ndarray]:
        """All subword ids in order, and how many each text has."""
        joined, many = subwords(self.words.tolist(), folder)
        first = np.cumsum(many) - many
        each = many[self.codes]
        start = np.repeat(first[self.codes], each)
        inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        ends = np.cumsum(self.sizes)
        total = np.concatenate([[0], np.cumsum(each)])[ends]
        return joined[start + inside], np.diff(np.r_[0, total])


def _chunks(batches):
    """(doc ids, held-out flags, texts) of a few megabytes each."""
    for batch in batches:
        keys, held, texts = (batch.column(i).to_pylist() for i in range(3))
        at = size = 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= CHUNK or i == len(texts) - 1:
                yield keys[at : i + 1], np.array(held[at : i + 1], dtype=bool), texts[at : i + 1]
                at, size = i + 1, 0


def _hashes(words) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, _SEED) for w in words), dtype=np.uint64, count=len(words))


def _lesson(rows: DataFrame, turn: int) -> DataFrame:
    """The learnt texts of one round."""
    at = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(ROUNDS))
    return rows.filter(~F.col("held_out") & (at == turn))


def common_words(rows: DataFrame) -> list[bytes]:
    """The commonest words of the learnt texts, and the end; sorted."""

    def run(batches):
        for _, _, texts in _chunks(batches):
            chunk = Chunk(texts)
            counts = np.bincount(chunk.codes, minlength=len(chunk.words))
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(chunk.words.tolist(), pa.binary()), "n": counts}
            )

    counts = rows.filter(~F.col("held_out")).mapInArrow(run, "word binary, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word")
    return sorted({b"", *(bytes(r["word"]) for r in top.limit(MOST_COMMON).collect())})


def _symbols(words: list[bytes], folder: str) -> np.ndarray:
    """Subword id to input symbol: the ids most used by the common words have their own."""
    seen = np.bincount(subwords(words, folder)[0], minlength=IDS)
    seen[END] = np.iinfo(np.int64).max
    order = np.lexsort((np.arange(IDS), -seen))[:OTHER]
    symbols = np.full(IDS, OTHER, dtype=np.int32)
    symbols[order] = np.arange(len(order))
    return symbols


def corpus_counts(rows: DataFrame, words: list[bytes], symbols: np.ndarray, folder: str) -> dict:
    """Counts over all learnt texts: common words, subword ids, pairs of symbols.

    Each task adds up its texts and hands on one row for each count; the driver gets
    as many as there are common words, ids and pairs of symbols.
    """
    place = {w: i for i, w in enumerate(words)}

    def run(batches):
        word_n = np.zeros(len(words), dtype=np.int64)
        id_n = np.zeros(IDS, dtype=np.int64)
        pair_n = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
        for _, _, texts in _chunks(batches):
            chunk = Chunk(texts)
            counts = np.bincount(chunk.codes, minlength=len(chunk.words))
            spots = np.array([place.get(w, -1) for w in chunk.words], dtype=np.int64)
            word_n += np.bincount(spots[spots >= 0], counts[spots >= 0], len(words)).astype(np.int64)
            ids, _ = chunk.pieces(folder)
            id_n += np.bincount(ids, minlength=IDS)
            here = symbols[ids].astype(np.int64)
            before = np.concatenate([[symbols[END]], here[:-1]])
            pair_n += np.bincount(before * SYMBOLS + here, minlength=SYMBOLS * SYMBOLS)
        for kind, counts in enumerate((word_n, id_n, pair_n)):
            some = np.flatnonzero(counts)
            for at in range(0, len(some), 10_000):
                part = some[at : at + 10_000]
                yield pa.RecordBatch.from_pydict(
                    {"kind": np.full(len(part), kind, dtype=np.int32), "at": part, "n": counts[part]}
                )

    found = rows.filter(~F.col("held_out")).mapInArrow(run, "kind int, at long, n long")
    totals = found.groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for kind, (name, size) in enumerate(
        (("words", len(words)), ("ids", IDS), ("pairs", SYMBOLS * SYMBOLS))
    ):
        part = totals[totals["kind"] == kind]
        counts[name] = np.zeros(size, dtype=np.int64)
        counts[name][part["at"].to_numpy(dtype=np.int64)] = part["n"].to_numpy(dtype=np.int64)
    return counts


def symbol_classes(pairs: np.ndarray) -> np.ndarray:
    """A class for each symbol, from the company it keeps.

    Symbols are described by what follows and what precedes them, reduced to their
    main directions, and grouped around centres that start far apart.
    """
    pairs = pairs[:PAD, :PAD].astype(float)
    follow = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    lead = np.sqrt(pairs.T / np.maximum(pairs.sum(axis=0)[:, None], 1))
    _, vectors = np.linalg.eigh(follow @ follow.T + lead @ lead.T)
    points = vectors[:, -16:]
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    centres = [int(pairs.sum(axis=1).argmax())]
    near = np.full(len(points), np.inf)
    while len(centres) < CLASSES:
        near = np.minimum(near, ((points - points[centres[-1]]) ** 2).sum(axis=1))
        centres.append(int(near.argmax()))
    middle = points[centres]
    for _ in range(20):
        group = ((points[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(group):
            middle[g] = points[group == g].mean(axis=0)
    return np.append(group, 0)


def tables(counts: dict, symbols: np.ndarray) -> dict[str, np.ndarray]:
    """What the counts say, as natural logarithms.

    ``classes`` of the symbols; ``pairs``, each class after each symbol; ``inside``, each
    symbol in its class after each symbol; ``own``, each id in its symbol.  Pairs fall
    back on single symbols as far as a symbol has many kinds of followers (Witten and
    Bell), and nothing has probability zero.
    """
    pairs = counts["pairs"].reshape(SYMBOLS, SYMBOLS)
    classes = symbol_classes(pairs)
    single = pairs.sum(axis=0)[:PAD] + 1.0
    single /= single.sum()
    kinds = (pairs[:, :PAD] > 0).sum(axis=1, keepdims=True) + 1.0
    follow = pairs[:, :PAD] + kinds * single
    follow /= follow.sum(axis=1, keepdims=True)
    of_class = np.zeros((SYMBOLS, CLASSES))
    for c in range(CLASSES):
        of_class[:, c] = follow[:, classes[:PAD] == c].sum(axis=1)
    # A class without a symbol has no share; any finite logarithm far down will do.
    logs = np.log(np.maximum(of_class, 1e-30))
    inside = np.zeros((SYMBOLS, SYMBOLS), dtype=np.float32)
    inside[:, :PAD] = np.log(follow) - logs[:, classes[:PAD]]
    ids = counts["ids"] + 1.0
    own = np.log(ids / np.bincount(symbols, ids, SYMBOLS)[symbols])
    return {"classes": classes, "pairs": logs.astype(np.float32), "inside": inside, "own": own}


def _inputs(ids: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, classes: np.ndarray):
    """Inputs and target classes laid out in blocks; the ids' places, symbols and those before."""
    places, size = attention.laid_out(lengths)
    now = symbols[ids]
    before = np.concatenate([symbols[[END]], now[:-1]])
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = symbols[END]
    laid = np.full(size, PAD, dtype=np.int32)
    targets = np.zeros(size, dtype=np.int32)
    laid[places], targets[places] = before, classes[now]
    return laid, targets, places, now, before


def train(rows: DataFrame, symbols: np.ndarray, known: dict, folder: str) -> dict[str, np.ndarray]:
    """Weights after rounds of learning in parallel, averaged after each.

    In a round every task goes over its part of the round's texts, and after the last
    round every learnt text has been gone over; averages are weighted by subwords and
    formed in Spark.
    """
    weights = attention.start()
    for turn in range(ROUNDS):
        now = attention.flat(weights)

        def run(batches, now=now):
            pupil, seen = attention.Trainer(attention.shaped(now), known["pairs"]), 0
            for _, _, texts in _chunks(batches):
                ids, lengths = Chunk(texts).pieces(folder)
                laid, targets, *_ = _inputs(ids, lengths, symbols, known["classes"])
                pupil.fit(laid, targets)
                seen += len(ids)
            if seen:
                learnt = attention.flat(pupil.weights).astype(np.float64) * seen
                yield pa.RecordBatch.from_pydict(
                    {"at": np.arange(len(learnt)), "x": learnt, "n": np.full(len(learnt), seen)}
                )

        found = _lesson(rows, turn).mapInArrow(run, "at long, x double, n long").groupBy("at")
        mean = found.agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        if len(mean):
            numbers = np.zeros(len(now))
            numbers[mean["at"].to_numpy()] = mean["x"].to_numpy()
            weights = attention.shaped(numbers)
    return weights


_PARCEL = "bucket int, chunk long, kind int, body binary"


def _packed(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], dtype=np.int64)
    return sizes.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpacked(body: bytes, *kinds: str) -> list[np.ndarray]:
    at, found = 8 * (1 + len(kinds)), []
    for size, kind in zip(np.frombuffer(body, np.int64, len(kinds), 8), kinds):
        found.append(np.frombuffer(body[at : at + int(size)], dtype=kind))
        at += int(size)
    return found


def _parcels(rows: DataFrame, model: dict, words: list[bytes], counts: np.ndarray, buckets: int,
             folder: str) -> DataFrame:
    """Scores of each chunk's texts, and for its other words who uses them how often.

    Common words are counted already and are settled here.
    """
    place = {w: i for i, w in enumerate(words)}
    logs = np.log10(counts + 1.0)

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, (keys, held, texts) in enumerate(_chunks(batches)):
            chunk = Chunk(texts)
            ids, lengths = chunk.pieces(folder)
            laid, targets, places, now, before = _inputs(
                ids, lengths, model["symbols"], model["classes"]
            )
            found = attention.log_probabilities(
                attention.shaped(model["weights"]), model["pairs"], laid, targets
            )[places].astype(np.float64)
            found += model["inside"][before, now] + model["own"][ids]
            first = np.cumsum(lengths) - lengths
            score = np.add.reduceat(found, first) / np.log(10)
            spots = np.array([place.get(w, -1) for w in chunk.words], dtype=np.int64)
            at = spots[chunk.codes]
            common = at >= 0
            n = len(texts)
            base = np.bincount(chunk.texts[common], logs[at[common]], n)
            known = np.bincount(chunk.texts[common], counts[at[common]] > 0, n).astype(np.int64)
            name = part << 32 | number
            body = _packed(
                np.array([0 if k is None else k for k in keys], dtype=np.int64),
                np.array([k is None for k in keys], dtype=np.uint8),
                held.astype(np.uint8),
                chunk.sizes,
                score,
                base,
                known,
            )
            rest, texts_of = chunk.codes[~common], chunk.texts[~common]
            uses, many = np.unique(rest.astype(np.int64) * n + texts_of, return_counts=True)
            code, text = uses // n, uses % n
            distinct, start, each = np.unique(code, return_index=True, return_counts=True)
            hashes = _hashes([chunk.words[i] for i in distinct])
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            out = [(name % buckets, name, 1, body)]
            for b in np.unique(bucket):
                mine = np.flatnonzero(bucket == b)
                spread = np.repeat(start[mine], each[mine]) + _inside(each[mine])
                out.append((int(b), name, 0, _packed(
                    hashes[mine], each[mine].astype(np.int32), text[spread].astype(np.int32),
                    many[spread].astype(np.int32), held.astype(np.uint8),
                )))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                names=["bucket", "chunk", "kind", "body"],
            )

    return rows.mapInArrow(run, _PARCEL)


def _inside(each: np.ndarray) -> np.ndarray:
    return np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)


def _settle(table: pa.Table) -> pa.Table:
    """One bucket of words: count each over all chunks, answer each chunk.

    A chunk's answer is, for its texts, the sum of log10(count + 1) and the known
    tokens; kind 2 has the bucket's tokens and distinct words.
    """
    out, asked = [], []
    for row in sorted(table.to_pylist(), key=lambda r: (r["chunk"], r["kind"])):
        if row["kind"] == 1:
            out.append(row)
        else:
            asked.append((row["chunk"], _unpacked(row["body"], "u8", "i4", "i4", "i4", "u1")))
    bucket = table.column("bucket")[0].as_py()
    if asked:
        learnt = []
        for _, (hashes, each, text, many, held) in asked:
            counts = np.where(held[text] > 0, 0, many)
            learnt.append(np.add.reduceat(counts, np.cumsum(each) - each))
        every = np.concatenate([a[1][0] for a in asked])
        _, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, np.concatenate(learnt))
        at = 0
        for chunk, (hashes, each, text, many, _) in asked:
            count = np.repeat(total[place[at : at + len(hashes)]], each)
            at += len(hashes)
            texts, where = np.unique(text, return_inverse=True)
            out.append({
                "bucket": bucket, "chunk": chunk, "kind": 0,
                "body": _packed(
                    texts.astype(np.int32),
                    np.bincount(where, many * np.log10(count + 1.0)),
                    np.bincount(where, many * (count > 0)).astype(np.int64),
                ),
            })
        sums = _packed(np.array([total.sum(), (total > 0).sum()], dtype=np.int64))
        out.append({"bucket": bucket, "chunk": -1, "kind": 2, "body": sums})
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
    return pa.Table.from_pylist(out, schema=schema)


_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"
)


def _gather(table: pa.Table) -> pa.Table:
    """One chunk: what all buckets answered, added to its own scores."""
    rows = sorted(table.to_pylist(), key=lambda r: (-r["kind"], r["bucket"]))
    keys, missing, held, sizes, score, base, known = _unpacked(
        rows[0]["body"], "i8", "u1", "u1", "i8", "f8", "f8", "i8"
    )
    base, known = base.copy(), known.copy()
    for row in rows[1:]:
        texts, sums, seen = _unpacked(row["body"], "i4", "f8", "i8")
        base[texts] += sums
        known[texts] += seen
    return pa.table(
        {
            "doc_id": pa.array(keys, pa.int64(), mask=missing > 0),
            "held_out": held > 0,
            "n_tokens": sizes,
            "n_known": known,
            "base_sum": base,
            "score": score,
        }
    )


def lm_scores(
    df: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    folder: str = TOKENIZERS,
) -> DataFrame:
    """One row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text is its words, lower-cased in A-Z, and an end.  ``base_score`` adds up
    log10((c + 1) / (N + V + 1)) of its tokens, with counts of the texts that are not
    held out.  ``score`` is the model's log10 probability of the same tokens as subword
    ids: a causal self-attention model gives the class of each next id, in windows of
    32 ids that overlap by half and score each id once, starting from counts of pairs;
    counts give the id in its class.

    Subword and word counts cover all learnt texts, and so do the lessons of the model.
    Words travel in parcels by hash; the commonest 10,000 are counted
    beforehand, so no task gets a word with all its texts.  The keys are whole numbers.

    A null or blank text is the end alone.  A null key stays null.  Repeated rows are
    scored one by one.  Without any learnt text all counts are 0.  An empty table
    gives no rows.
    """
    rows = even(
        df.select(
            F.col(key).cast("long").alias("doc_id"),
            F.coalesce(held_out, F.lit(False)).alias("held_out"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    words = common_words(rows)
    symbols = _symbols(words, folder)
    counts = corpus_counts(rows, words, symbols, folder)
    known = tables(counts, symbols)
    weights = attention.flat(train(rows, symbols, known, folder))
    model = known | {"symbols": symbols, "weights": weights}
    parcels = _parcels(rows, model, words, counts["words"], -(-size // BUCKET) or 1, folder)
    answers = written(parcels.groupBy("bucket").applyInArrow(_settle, _PARCEL), "lm-answers")
    tokens, distinct = int(counts["words"].sum()), int((counts["words"] > 0).sum())
    for row in answers.filter("kind = 2").select("body").toLocalIterator():
        more = _unpacked(bytes(row["body"]), "i8")[0]
        tokens, distinct = tokens + int(more[0]), distinct + int(more[1])
    scored = answers.filter("kind < 2").groupBy("chunk").applyInArrow(_gather, _SCORED)
    room = float(np.log10(tokens + distinct + 1))
    return scored.select(
        F.col("doc_id").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * room).alias("base_score"),
        "score",
    )
