"""Small tables with the awkward cases every operator has to take."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Column names that operators use inside.
CLASHING = ("id", "rep", "key", "n", "a", "b", "component", "shard", "slot", "found", "_rules", "_id", "_bucket", "_row", "v", "rank", "score", "w", "spans", "at")


def frame(spark, texts, first=0):
    """texts: strings (or nulls), or (doc_id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (first + k, t) for k, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], SCHEMA)


def clashing(df):
    """The same table with further columns whose names operators use inside."""
    for name in CLASHING:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(size)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    out = []
    for w in text.split(" "):
        roll = rng.random()
        out += [] if roll < share / 3 else [w, prose(rng, 1)] if roll < share * 2 / 3 else [prose(rng, 1)] if roll < share else [w]
    return " ".join(out)
