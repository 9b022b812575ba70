"""Secrets: the patterns against a loop, and the models on strings that they have not seen."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.llm import queries
from larkspur.llm.secret_scan import Models, _counts_of, drawn_strings, scan, train

DATA = "/root/testdata/sf0.001"
# typed by hand: names as programs and pages have them
ORDINARY = """getUserAccountBalance MAX_RETRY_COUNT_LIMIT internationalization INTERNATIONALIZATION HttpServletRequestWrapper donaudampfschifffahrt
    Rechtsschutzversicherung com/path/2024-01-03/article-name sha256sum_of_file_v2 utf8mb4_unicode_ci_x default_timeout_seconds application/x-www-form-urlencoded
    org/apache/commons/collections AbstractFactoryProviderBean text-decoration-underline 4111-1111-1111-1111 DE89370400440532013000 2024-01-01T00
    src/main/resources/messages _________________________ aaaaaaaaaaaaaaaaaaaaaaaa ==================== xxxxxxxx-xxxx-xxxx-xxxx""".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def models(docs):
    return train(docs)


def found_in(spark, models, texts):
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("secrets", F.lit(1)), models).collect()
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in rows}


def base(text):
    """The contract's patterns by a loop, as (kind, start, end)."""
    out = []
    for kind, pattern, group, least in (("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_spans_equal_a_loop(spark, models):
    key = "0123456789abcdef" * 2
    texts = [
        None, "", " ", "password: hunter2", "PassWord = 'hunter22", 'say "token":"abc.def-ghi=" and secret=short', f"täglich 日本語🎉 api_key={key} {key}", f"apikey : {key}x{key}",
        "AKIA" + "A" * 12 + " AKIA" + "B" * 11, "toKen=abcdefghij", "paſſword=abcdefghij", "token\n=abcdefghij", "token = = abcdefghij", "f" * 31 + " " + "f" * 32, f"secret=token={key}", "passwd:password=aaaaaaaa", "x" * 300_000 + f" token={key}",
    ]
    got = found_in(spark, models, texts)
    for k, text in enumerate(texts):
        assert [s for s in got[k] if s[0] != "random"] == base(text or ""), text


def test_query_is_the_contract_on_whole_documents(spark, docs):
    rows = {r.doc_id: r for r in queries.op12_secret_scan(spark, DATA).collect()}
    for doc_id, text in docs.collect():
        spans = base(text or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = rows.pop(doc_id)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in said.split(",") if x]
    assert not rows


def test_random_strings_are_found_and_names_are_not(spark, models):
    draw = random.Random(99)  # other strings than those of the training
    letters = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
    strings = ["".join(draw.choices(a, k=draw.choice([20, 28, 31]))) for a in letters for _ in range(60)]
    got = found_in(spark, models, [f"Größe: {s}, und so weiter" for s in strings])
    exact = [got[k] == [("random", 7, 7 + len(s))] for k, s in enumerate(strings)]
    assert sum(exact) >= 0.97 * len(strings), sum(exact)
    assert found_in(spark, models, ORDINARY) == {k: [] for k in range(len(ORDINARY))}


def test_prose_stays_clean(docs, models):
    prose = docs.where("not text rlike '(?i)token|password|[0-9a-f]{16}|[0-9A-F]{16}'")
    assert scan(prose, models).where("size(secrets) > 0").count() == 0 < prose.count()


def test_random_strings_in_a_base_span_are_not_told_twice(spark, models):
    key = "Xk9fQz2LmPw7RtYvB3"
    text = f"token={key} {key} {key}"
    assert found_in(spark, models, [text])[0] == [("assign", 0, 24), ("random", 25, 43), ("random", 44, 62)]


def test_transition_counts_and_ratio():
    counts = _counts_of(["ab", "ab", "a", "", "b-"])
    a, b, dash = 1, 2, 67
    assert counts[0, a] == 3 and counts[a, b] == 2 and counts[a, 0] == 1 and counts[b, 0] == 2 and counts[b, dash] == counts[dash, 0] == 1 and counts.sum() == 11
    models = Models.of([_counts_of(drawn_strings())], _counts_of(["token", "number", "reader"] * 50))
    assert models.of_string("numbertoken") < 0 < models.of_string("x7Q2vK9pLr4")


def test_training_on_odd_rows(spark):
    rows = spark.createDataFrame([(None,), ("",), ("🎉",)], "text string").selectExpr("text", "1 as row", "2 as sample", "3 as n")
    assert found_in(spark, train(rows), ["hello there", "Xk9fQz2LmPw7RtYvB3"])[0] == []
    assert train(rows.where("false")).ratio.shape == (68, 68)
