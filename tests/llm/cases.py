"""Small tables that hold what every operator must stand."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, digest string, base string, own string"
LONG = " ".join(f"wort{i % 977}é" for i in range(20_000))
LINE = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn"


def rows() -> list[tuple]:
    texts = [None, "", " ", "a", LINE, LINE, "x " + LINE + " y", LONG, LONG, "\n\t", "!!!", LINE + " sechzehn", LONG + " Ende", "password = hunter2secret", "日本語 текст ß"]
    out = [(i, t, "de" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t), "g", "d", "b", "o") for i, t in enumerate(texts)]
    return [*out, out[4], (None, "no id", None, None, None, None, None, None, None)]


def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts() -> dict[int, str]:
    return {r[0]: r[1] or "" for r in rows() if r[0] is not None}
