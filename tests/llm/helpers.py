"""Small documents and plain versions of the operators to hold their results against."""

import collections
import hashlib
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 997} and{i}" for i in range(20_000))


def docs(spark, texts, **columns):
    """Documents of the texts, or of (doc_id, text) pairs."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, columns.get("lang", {}).get(i, "en"), columns.get("source", {}).get(i, "s"), None if t is None else len(t)) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """With further columns named as those that operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in ("kept", "n", "run", "id", "rep", "component_id", "t", "w", "copy", "at", "ids", "digest", "anchor", "place", "__hit")})


def table_dir(spark, tmp_path, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= size:
        return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def classes(rows, size, num, den):
    """id -> (set size, smallest id reached by links): all pairs that share a shingle."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in by[x] if j < i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(rows, window=200):
    """id -> n_bytes, n_removed, n_spans, digest of what is kept: every window looked up."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[s : s + window] for _, b in texts for s in range(len(b) - window + 1))
    out = {}
    for i, b in texts:
        gone = [False] * len(b)
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = [True] * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def collected(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}
