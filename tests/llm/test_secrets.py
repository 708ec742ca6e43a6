import hashlib
import random
import re

from llm_cases import messy, nothing, rows_of  # noqa: F401
from qamill.llm import secrets as S

PLAIN = [
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def brute(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, p, g, least) in enumerate(PLAIN)
             for m in p.finditer(text or "") if len(m[g]) >= least]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def test_base_spans_equal_a_plain_search():
    rng = random.Random(1)
    bits = ["password", "PassWd", "toKen", "api_key", "ApiKey", "secret", "ſecret", " ", "=", ":", '"', "'", "AKIA", "ABC123XYZ",
            "0123456789abcdef", "dead", "é", "zz", "-", "+", "\n", "K", "token = ", "short"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        spans = [s for s in S.scan(text, S.Model({}, [])) if s[0] != "format"]
        assert [f"{k}:{a}:{b}" for k, a, b, _ in spans] == brute(text), text


def test_merged_automaton_keeps_the_format():
    rng = random.Random(2)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    digest = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    ordinary = ["".join(rng.choice("etaoinshrdlu.") for _ in range(rng.randint(16, 24))) for _ in range(300)]
    ordinary += [str(rng.randrange(10**15, 10**16)) for _ in range(100)]
    model = S.Model({"access": [key() for _ in range(300)], "hex": [digest() for _ in range(300)]}, ordinary)
    tree = sum(len(set(w[:i] for w in [S.classes(key()) for _ in range(300)])) for i in range(21))
    assert all(len(a.states) < tree / 4 for a, *_ in model.kinds.values())
    found = [model.score(key()) is not None for _ in range(200)] + [model.score(digest()) is not None for _ in range(200)]
    assert sum(found) >= 0.9 * len(found)
    wrong = ["report_2023_final.pdf", "/usr/share/python3.13/lib", "2024-01-02T03.04.05Z", "1234567890123456", *ordinary]
    assert not any(model.score(w) is not None for w in wrong)


def test_messy_rows(messy, nothing):
    rows = rows_of(S.digest_columns(S.find_secrets(messy)))
    assert len(rows) == messy.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" and r["n_assign"] == 0 for r in rows)
    assert S.digest_columns(S.find_secrets(nothing)).count() == 0


def test_redaction_keeps_columns_and_joins_overlaps(spark):
    value = "0123456789abcdef01234567"
    docs = spark.createDataFrame([(1, f"a token = {value} b", "x"), (2, None, "x"), (3, "clean", "x")], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r["text"] for r in rows_of(S.redact(docs))}
    assert rows == {1: "a [SECRET] b", 2: None, 3: "clean"}
    assert S.redact(docs).columns == docs.columns


def test_query_on_the_small_tables(spark):
    from conftest import SMALL
    from qamill.llm import registry
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for row in rows_of(registry.queries()["op1_secret_scan"](spark, SMALL)):
        want = brute(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(row["spans"].split(",") if row["spans"] else [])
        assert row["n_hex"] == sum(w.startswith("hex") for w in want)
