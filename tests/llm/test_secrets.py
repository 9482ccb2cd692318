import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from lodestrata.llm import secrets

from . import cases

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


#: The rules, written out once more: what suppresses a candidate, and the classes with window and bits.
ALLOWED = [re.compile(p) for p in (
    "(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]", "^[A-Za-z]+$", "^[0-9]+$", "^[=_/+-]+$", r"(.)\1\1\1\1\1\1\1", "(?i)abcdefgh|01234567|12345678|qwerty",
    "^/?[A-Za-z]{2,}([/_=-]+([A-Za-z]{2,}|[0-9]{1,4}))+[/_=-]*$", "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
)]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = [("0123456789ABCDEF", 24, 3.0), (UPPER + UPPER.lower() + "0123456789+/_=-", 24, 4.0)]


def candidates(text):
    """Runs of 24 or more token characters; an upper-case hex number of 24 or more characters in one is a candidate of its
    own, and so are 24 or more characters before the first and between such numbers."""
    for run in re.finditer("[A-Za-z0-9+/_=-]+", text):
        at = run.start()
        for m in re.finditer("(?<![0-9A-F])[0-9A-F]{24,}|$", run[0]):
            if run.start() + m.start() - at >= 24:
                yield at, run.start() + m.start()
            if m[0]:
                yield run.start() + m.start(), run.start() + m.end()
                at = run.start() + m.end()


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def said(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def entropy(candidate, letters, size):
    kept = [c for c in candidate if c in letters]
    best = None
    for i in range(len(kept) - size + 1):
        window = kept[i : i + size]
        value = -sum(p * math.log2(p) for p in (window.count(c) / size for c in set(window)))
        best = value if best is None else max(best, value)
    return best


def extra(text, spans):
    out = []
    for start, end in candidates(text):
        found = text[start:end]
        if any(a < end and start < b for a, _, b in spans) or any(p.search(found) for p in ALLOWED):
            continue
        for letters, size, bits in RULES:
            value = entropy(found, letters, size) if len(letters) > 16 or re.fullmatch("[0-9A-F]+", found) else None
            if value is not None and value >= bits:
                out.append((start, 3, end))
                break
    return out


def texts():
    draw = random.Random(2)
    key = lambda n, of="ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789": "".join(draw.choices(of, k=n))
    parts = [
        lambda: "password: token: abcdefgh", lambda: "password=token=abcdefgh", lambda: f"API_KEY = '{key(12)}'", lambda: 'secret":"x1"', lambda: "SeCrEt=  abc.def-ghi",
        lambda: "AKIA" + key(16, "ABCDEFG0123"), lambda: "AKIA" + key(15, "ABCDEFG0123"), lambda: "AKIAAKIA" + key(20, "ABCDEFG0123"), lambda: key(24, "0123456789abcdef"), lambda: key(23, "0123456789abcdef"),
        lambda: key(40), lambda: key(64, "0123456789ABCDEF"), lambda: "exampleexample" + key(30), lambda: "thequickbrownfoxjumpsoverthelazydog", lambda: "src/main/java/org/some/deep/folder/name", lambda: "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", lambda: "é日本 ", lambda: "123e4567-e89b-12d3-a456-426614174000",
        lambda: " ", lambda: "\n", lambda: "passwd", lambda: "=",
    ]
    return ["".join(draw.choice(parts)() + draw.choice([" ", "", "\n"]) for _ in range(draw.randint(0, 8))) for _ in range(400)] + list(cases.texts().values())


def test_spans_are_those_of_a_plain_scan(spark):
    rows = list(enumerate(texts()))
    found = {r.doc_id: r for r in secrets.secret_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        spans = base(text)
        r = found[doc_id]
        assert r.base_sha256 == hashlib.sha256(said(spans).encode()).hexdigest(), text
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in spans) for kind in range(3))
        assert r.spans == said(sorted(spans + extra(text, spans))), text


def test_odd_rows(spark):
    found = secrets.secret_digests(cases.odd(spark))
    assert found.count() == len(cases.rows()) and secrets.secret_digests(cases.empty(spark)).count() == 0
    assert [r.n_assign for r in found.where("doc_id in (0, 13)").orderBy("doc_id").collect()] == [0, 1]


def test_redaction_keeps_columns_and_hides_spans(spark):
    df = cases.odd(spark)
    out = secrets.redact_secrets(df)
    assert out.schema == df.schema or out.columns == df.columns
    before, after = {r.doc_id: r for r in df.collect()}, {r.doc_id: r for r in out.collect()}
    assert after[13].text == "[secret]" and after[13].n_chars == len("[secret]")
    assert all(after[i] == before[i] for i in before if i != 13)
    many = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    for r in secrets.redact_secrets(many).collect():
        text, at, want = texts()[r.doc_id], 0, ""
        spans = base(text)
        for a, _, b in sorted(spans + extra(text, spans)):
            if a >= at:
                want += text[at:a] + "[secret]"
            at = max(at, b)
        assert r.text == want + text[at:]


def test_entropy_of_a_window(spark):
    letters = secrets.CLASSES[1]
    said_ = ["abcdefghijklmnopqrstuvwxyz", "a" * 30, "short", "Zz09+/" * 8]
    rows = spark.createDataFrame([(x,) for x in said_], "x string").select("x", secrets.windowed_entropy(F.col("x"), letters).alias("e")).collect()
    for r in rows:
        want = entropy(r.x, letters.letters, letters.window)
        assert (r.e is None) == (want is None) and (want is None or abs(r.e - want) < 1e-9)


def test_planted_secrets_behind_signs_and_names_are_found(spark):
    number, random_ = "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822C", "q7Rz2LmX9vKd4TnB8wYcJ5hGf3PsQ6Ua"
    planted = {
        f"use --auth={random_} here": f"--auth={random_}",
        f"cfg[0]={random_}": f"={random_}",
        f"+{random_}==": f"+{random_}==",
        f"/{random_}": f"/{random_}",
        f"SIGNING_KEY={number}": number,
        f"{number}-x": number,
        f"a_rather_long_name_of_a_key_={number}=": number,
        number: number,
    }
    plain_ = ["=_-+/=_-+/=_-+/=_-+/=_-+/=_-+/", "=" * 60]
    rows = list(enumerate([*planted, *plain_]))
    found = {r.doc_id: r for r in secrets.secret_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        want = planted.get(text)
        assert found[doc_id].spans == ("" if want is None else f"entropy:{text.index(want)}:{text.index(want) + len(want)}"), text
    hidden = secrets.redact_secrets(spark.createDataFrame(rows[: len(planted)], "doc_id long, text string")).collect()
    assert not any(random_ in r.text or number in r.text for r in hidden)


def test_many_matches_in_one_text(spark):
    """Thousands of spans, places behind many blocks, and pieces cut across them; in time that grows with the text."""
    draw = random.Random(7)
    key = lambda n: "".join(draw.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k=n))
    parts = [lambda: "token=abcdefgh", lambda: key(32), lambda: "AKIA" + "A1B2" * 4, lambda: f"{draw.randrange(16**30):030x}", lambda: "é" * draw.randint(1, 300), lambda: "word"]
    text = " ".join(draw.choice(parts)() for _ in range(12_000))
    df = spark.createDataFrame([(1, text), (2, text[:5000] + "\U0001F600" * 5000 + "password=abcdefg")], "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.secret_digests(df).collect()}
    hidden = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    for doc_id, said_text in ((r.doc_id, r.text) for r in df.collect()):
        spans = sorted(base(said_text) + extra(said_text, base(said_text)))
        assert found[doc_id].spans == said(spans)
        at, want = 0, ""
        for a, _, b in spans:
            if a >= at:
                want += said_text[at:a] + "[secret]"
            at = max(at, b)
        assert hidden[doc_id] == want + said_text[at:]


def test_long_runs_of_token_characters(spark):
    """Candidates of a million characters neither exhaust the stack nor take more than their share of time."""
    draw = random.Random(11)
    random_ = "".join(draw.choices(UPPER + UPPER.lower() + "23456789", k=60))
    long = {"ab-": "", "a1/": "", "x": "", "aB3=": "", "abc/1234_": "", "-": "", "word=": ""}
    rows = [(f"{unit}{size}", unit * (size // len(unit))) for unit in long for size in (1_000, 6_000, 100_000, 1_000_000)]
    rows += [("key", ("ab-" * 40_000) + random_), ("path", "/" + "folder/" * 30_000 + "2024"), ("bad", "//" + "folder/" * 3_000), ("digits", "folder/" * 3_000 + "20245")]
    df = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(rows)], "doc_id long, text string, name string")
    found = {r.doc_id: r.spans for r in secrets.secret_digests(df).collect()}
    hidden = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    for i, (name, text) in enumerate(rows):
        spans = [] if len(text) > 100_000 and name != "key" else extra(text, base(text)) if len(text) <= 6_000 else None
        if name == "key":
            assert found[i] == f"entropy:0:{len(text)}" and hidden[i] == "[secret]"
        elif name == "path":
            assert found[i] == ""
        elif spans is not None and len(text) <= 6_000:
            assert found[i] == said(spans), name
