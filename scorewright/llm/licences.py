"""Licence scans with a positional index of rare words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import fenced

# What stands between words, the phrases of the base and their labels.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, notice, and the phrases of it that must be there.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3",
     ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2",
     ["gnu general public license", "version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license",
     ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license",
     ["gnu affero general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software", ["hereby granted free of charge", "copy of this software"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
     "permitted", ["source and binary forms", "are permitted"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
     "or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license", "2 0"]),
    ("epl", "made available under the terms of the eclipse public license",
     ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["unencumbered software", "public domain"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc0", "to the extent possible under law the author has dedicated all copyright to the "
     "public domain cc0", ["under law", "public domain"]),
]

FOUND = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
RARE_WORDS = 3
# A candidate is one number: its template above these bits, its start (from -1024) below.
_BITS = 40
_SHIFT = 1024


def tokens(text: Column) -> Column:
    """Words in lower case; an empty string may stand first and last.

    Only A-Z need to change, and no other letter may turn into one of theirs: the
    Kelvin sign would.
    """
    apart = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))
    return F.split(F.lower(apart), GAP)


def document_counts(df: DataFrame, text: str = "text") -> dict[str, int]:
    """How many texts hold each word of the templates."""
    known = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    own = F.array_distinct(F.filter(tokens(F.col(text)), lambda w: w.isin(known)))
    counts = df.select(F.explode(own).alias("word")).groupBy("word").count()
    return dict.fromkeys(known, 0) | {r["word"]: r["count"] for r in counts.collect()}


def rare_index(counts: dict[str, int], rare: int = RARE_WORDS) -> tuple[dict, list[int]]:
    """Postings of each template's rarest words, and how many each template has.

    The inverse document frequency falls with the count; ties go to the smaller word.
    A posting is (template, position).
    """
    postings: dict[str, list[tuple[int, int]]] = {}
    need = []
    for number, (_, notice, _) in enumerate(TEMPLATES):
        words = notice.split()
        rarest = sorted(set(words), key=lambda w: (counts[w], w))[:rare]
        places = [(w, at) for at, w in enumerate(words) if w in rarest]
        need.append(len(places))
        for word, at in places:
            postings.setdefault(word, []).append((number, at))
    return postings, need


def _phrase_places(notice: str, phrases: list[str]) -> list[tuple[int, int, str]]:
    words, found = notice.split(), []
    for phrase in phrases:
        parts = phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(parts)] == parts)
        found.append((at, len(parts), phrase))
    return found


def _sql(value) -> str:
    """A literal of nested lists, strings and whole numbers."""
    if isinstance(value, list):
        return f"array({', '.join(map(_sql, value))})"
    if isinstance(value, tuple):
        return f"struct({', '.join(map(_sql, value))})"
    return f"'{value}'" if isinstance(value, str) else str(value)


def scan(df: DataFrame, counts: dict[str, int], text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score.

    Each rare word of a text looks up its postings; a posting says where the template
    would start.  A start that all rare words of the template agree on is a candidate,
    and counts if the mandatory phrases stand at their places.  ``score`` is the
    largest share of a template's words at their places; 0.5 for base labels alone;
    0 without any.

    All steps are expressions on one row: nothing is shuffled.  A null or empty text
    has no words and no labels; ``first_word`` and ``last_word`` are then null.
    """
    postings, need = rare_index(counts)
    packed = {w: [(t << _BITS) - at + _SHIFT for t, at in p] for w, p in postings.items()}
    index = F.expr(f"map({', '.join(f'{_sql(w)}, {_long(p)}' for w, p in sorted(packed.items()))})")
    needs = F.expr(_sql(need))
    notices = F.expr(_sql([n.split() for _, n, _ in TEMPLATES]))
    phrases = F.expr(_sql([_phrase_places(n, p) for _, n, p in TEMPLATES]))
    names = F.expr(_sql([label for label, _, _ in TEMPLATES]))
    anchors = sorted({*postings, *(p.split()[0] for p in BASE)})

    toks = F.col("_toks")
    rows = df.withColumn("_toks", tokens(F.col(text)))
    rows = rows.withColumns(
        {
            "_off": (F.get(toks, F.lit(0)) == "").cast("int"),
            "_hits": F.filter(
                F.transform(toks, lambda w, i: F.when(w.isin(anchors), i)),
                lambda i: i.isNotNull(),
            ),
        }
    )
    places = {f"_base{n}": _places(toks, phrase.split()) for n, phrase in enumerate(BASE)}
    votes = F.sort_array(
        F.flatten(
            F.transform(
                "_hits",
                lambda i: F.transform(
                    F.coalesce(
                        F.try_element_at(index, F.get(toks, i)), F.array().cast("array<bigint>")
                    ),
                    lambda p: p + i - F.col("_off"),
                ),
            )
        )
    )
    rows = rows.withColumns({**places, "_votes": votes})
    agreed = F.filter(
        F.transform(
            "_votes",
            lambda v, i: F.when(
                F.get("_votes", i + F.get(needs, _template(v)) - 1) == v, v
            ),
        ),
        lambda v: v.isNotNull(),
    )
    rows = rows.withColumn("_agreed", F.array_distinct(agreed))
    start = lambda v: _start(v) + F.col("_off")
    right = F.filter(
        "_agreed",
        lambda v: F.forall(
            F.get(phrases, _template(v)),
            lambda p: (start(v) + p["col1"] >= 0)
            & (
                F.array_join(
                    F.slice(toks, F.greatest(start(v) + p["col1"] + 1, F.lit(1)), p["col2"]), " "
                )
                == p["col3"]
            ),
        ),
    )
    rows = rows.withColumn("_right", right)
    share = F.transform(
        "_right",
        lambda v: F.size(
            F.filter(
                F.get(notices, _template(v)), lambda w, j: F.get(toks, start(v) + j) == w
            )
        )
        / F.size(F.get(notices, _template(v))),
    )
    found = [F.size(f"_base{n}") > 0 for n in range(len(BASE))]
    base_labels = F.array_compact(
        F.array(*[F.when(hit, label) for hit, label in zip(found, BASE.values())])
    )
    starts = F.concat(*[f"_base{n}" for n in range(len(BASE))])
    size = F.size(toks)
    rows = rows.withColumns(
        {
            "n_words": F.greatest(
                F.lit(0),
                size - F.col("_off") - (F.get(toks, size - 1) == "").cast("int"),
            ).cast("long"),
            "_labels": base_labels,
            "_starts": starts,
            "_share": F.array_max(share),
        }
    )
    labels = F.concat("_labels", F.transform("_right", lambda v: F.get(names, _template(v))))
    scanned = rows.withColumns(
        {
            "n_base": F.size("_starts").cast("long"),
            "first_word": (F.array_min("_starts") - F.col("_off")).cast("long"),
            "last_word": (F.array_max("_starts") - F.col("_off")).cast("long"),
            "base_labels": F.array_join(F.array_sort("_labels"), ","),
            "labels": F.array_join(F.array_sort(F.array_distinct(labels)), ","),
            "score": F.coalesce("_share", F.when(F.size("_labels") > 0, 0.5).otherwise(0.0)),
        }
    )
    return fenced(scanned.select(*df.columns, *FOUND), *FOUND)


def _places(toks: Column, parts: list[str]) -> Column:
    """Of the hits those at which these words begin."""

    def here(i: Column) -> Column:
        return _all([F.get(toks, i + j) == part for j, part in enumerate(parts)])

    return F.filter("_hits", here)


def _long(values: list[int]) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def _all(conditions: list[Column]) -> Column:
    whole = conditions[0]
    for condition in conditions[1:]:
        whole = whole & condition
    return whole


def _template(vote: Column) -> Column:
    return F.shiftright(vote, _BITS).cast("int")


def _start(vote: Column) -> Column:
    return (vote.bitwiseAND(F.lit((1 << _BITS) - 1)) - _SHIFT).cast("int")
