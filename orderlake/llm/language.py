"""Language identification by rank-order profiles.

A text's n-grams of one to three characters are taken within words of letters, lower-cased, with a mark at either end of
a word. A language's profile is the ``TOP`` most frequent n-grams of all its training documents; a document is compared
with each profile by the out-of-place distance: for each of its own most frequent n-grams, how far its rank is from the
rank in the profile, ``TOP`` if it isn't there. The nearest profile wins.

N-grams are counted in numpy over slices of Arrow batches; each task sends its counts summed, Spark adds them up, and
what comes to the driver is ``TOP`` rows for each language.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing was learned; equal counts rank by
the n-gram's characters, equal distances by language name; repeated rows come out alike; further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from orderlake.llm.common import table
from orderlake.llm.pieces import chunks

TOP, LONGEST_GRAM = 300, 3
#: Bits of a letter in an n-gram's number; letters end below this.
BITS, LETTERS = 18, 1 << 18
NOTHING = "und"


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Code point -> that of its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.int32)
    for c in range(LETTERS):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            out[c] = ord(s.lower()[0])
    return out


def counted(texts: list[str], owners: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, n-gram's number and count of all distinct n-grams of each owner, in order, and which texts have a letter.
    Owners are the texts, or what ``owners`` gives for each. A number has the n-gram's characters in BITS each, below its
    length; 0 stands for a word's end."""
    raw = " ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass")
    code = folded()[np.frombuffer(raw, "<u4")]
    text = np.repeat(np.arange(len(texts) + 1), np.array([1, *[len(t) + 1 for t in texts]], np.int64)) - 1  # the mark after a text is its own
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code, text = code[keep], text[keep]
    lettered = np.bincount(text[code != 0], minlength=len(texts)) > 0
    there = np.zeros(LETTERS, bool)
    there[code] = there[0] = True
    letters = np.flatnonzero(there)  # the slice's alphabet, 0 first
    small = np.zeros(LETTERS, np.int64)
    small[letters] = np.arange(len(letters))
    code, base = small[code], len(letters)
    owner = text if owners is None else owners[text]
    inside = code != 0
    shift = (LONGEST_GRAM + 1) * base**LONGEST_GRAM
    keys = []
    for n in range(1, LONGEST_GRAM + 1):  # by the n-gram's last but one place, which is a letter; a mark is only at its ends
        m = max(len(code) - n + 1, 0)
        number = np.full(m, n, np.int64)
        for i in range(n):
            number = number * base + code[i : i + m]
        if n == 2:
            good, own = inside[:m] | inside[1 : m + 1], np.where(inside[:m], owner[:m], owner[1 : m + 1])
        else:
            good, own = inside[n // 2 : n // 2 + m], owner[n // 2 : n // 2 + m]
        keys.append((own * shift + number)[good])
    key = np.concatenate(keys)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    owner, number = np.divmod(key[first], shift)
    length = np.ones(len(number), np.int64)
    for k in range(2, LONGEST_GRAM + 1):
        length += number >= k * base**k
    gram = length.copy()
    for i in range(LONGEST_GRAM - 1, -1, -1):
        digit = np.where(i < length, number // base ** np.minimum(i, length) % base, 0)
        gram = np.where(i < length, gram << BITS | letters[digit], gram)
    return owner, gram, n, lettered


def counts(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, gram, n of every language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add_up(lang: str) -> None:
            values, at = np.unique(np.concatenate([x for x, _ in held[lang]]), return_inverse=True)
            held[lang] = [(values, np.bincount(at, np.concatenate([n for _, n in held[lang]]).astype(np.float64)).astype(np.int64))]

        for batch in batches:
            for part in chunks(batch, "t", 1_000_000):
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                at = {x: i for i, x in enumerate(names)}
                which, gram, n, _ = counted(part.column("t").to_pylist(), np.array([at[x] for x in langs]))
                for i, lang in enumerate(names):
                    held.setdefault(lang, []).append((gram[which == i], n[which == i]))
                    if len(held[lang]) > 16:
                        add_up(lang)
        for lang in held:
            add_up(lang)
            (values, n), = held[lang]
            yield pa.record_batch([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n)], ["lang", "gram", "n"])

    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    return rows.mapInArrow(run, "lang string, gram long, n long")


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> dict[str, list[int]]:
    """Language -> its n-grams, most frequent first."""
    sums = counts(df, lang_col, text_col).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    found: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "r").collect():
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


def predict(df: DataFrame, profiles: dict[str, list[int]], keep: list[str], text_col: str = "text", top: int = TOP) -> DataFrame:
    """The columns ``keep``, lang_pred and score."""
    rows = df.select(*[F.col(c) for c in keep], F.col(text_col).alias("t"))
    names = sorted(profiles)
    known = np.unique(np.array([g for x in names for g in profiles[x]], np.int64)) if names else np.zeros(0, np.int64)
    ranks = np.full((len(names), len(known) + 1), top, np.int64)  # in the last column, n-grams of no profile
    for i, x in enumerate(names):
        ranks[i, np.searchsorted(known, profiles[x])] = np.arange(len(profiles[x]))

    def nearest(texts: list[str]) -> tuple[list[str], list[float]]:
        doc, gram, n, lettered = counted(texts)
        pred, score = np.full(len(texts), -1), np.zeros(len(texts))
        if len(names) and len(doc):
            order = np.lexsort((gram, -n, doc))
            doc, gram = doc[order], gram[order]
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.concatenate([first, [len(doc)]])))
            doc, gram, rank = doc[rank < top], gram[rank < top], rank[rank < top]
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            at = np.searchsorted(known, gram)
            at = np.where(known[np.minimum(at, len(known) - 1)] == gram, np.minimum(at, len(known) - 1), len(known))
            far = np.stack([np.add.reduceat(np.where(r[at] < top, np.abs(r[at] - rank), top), first) for r in ranks])
            each = np.diff(np.concatenate([first, [len(doc)]]))
            best = far.argmin(0)
            pred[doc[first]] = best
            score[doc[first]] = 1 - far.min(0) / (each * top)
        pred = np.where(lettered, pred, -1)
        return [names[i] if i >= 0 else NOTHING for i in pred], np.where(pred >= 0, score, 0.0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t", 1_000_000):
                pred, score = nearest([x or "" for x in part.column("t").to_pylist()])
                yield pa.record_batch([*part.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "lang_pred string, score double"]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    return predict(docs, learn(docs.where("NOT held_out")), ["doc_id", "held_out"])
