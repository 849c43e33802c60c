import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import secrets

KINDS = ["assign", "access", "hex", "literal"]
FORMS = [
    'NAME = "VALUE"', "NAME='VALUE';", '{"NAME": "VALUE", "other": 1}', "NAME: VALUE\nnext: 1", "export NAME=VALUE", 'cfg["NAME"] = "VALUE"', "set('NAME', 'VALUE')", "<NAME>VALUE</NAME>",
    '<add key="NAME" value="VALUE"/>', "NAME: str = 'VALUE'", 'var NAME string = "VALUE"', 'char NAME[] = "VALUE";', "tool --NAME VALUE -v", 'NAME := "VALUE"', '"NAME" => "VALUE"', 'if NAME == "VALUE":', "self.x.NAME = `VALUE`",
]
NAMES = ["db_password", "dbPwd", "clientSecret", "AUTH_TOKEN", "private_key", "apiKey", "passphrase"]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def literal(rng):
    return "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(10)) + "x7Q"


def slow_base(text):
    """The fixed patterns, character by character."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    out, i = [], 0
    while i < len(text):
        ends = [i + len(k) for k in ("password", "passwd", "secret", "token", "apikey", "api_key") if low.startswith(k, i)]
        j = ends[0] if ends else None
        if j is not None:
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] in (":", "="):
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                end = j
                while end < len(text) and text[end] in allowed:
                    end += 1
                if end > j:
                    if end - j >= 6:
                        out.append((i, 0, end, "assign"))
                    i = end
                    continue
        i += 1
    for rank, kind, least, start, inside in ((1, "access", 20, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), (2, "hex", 24, "", "0123456789abcdef")):
        i = 0
        while i < len(text):
            if text.startswith(start, i) and text[i + len(start) : i + len(start) + 1] and text[i + len(start)] in inside:
                end = i + len(start)
                while end < len(text) and text[end] in inside:
                    end += 1
                if end - i >= least:
                    out.append((i, rank, end, kind))
                i = end
            else:
                i += 1
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_query_columns_against_the_slow_base(spark, corpus, tmp_path):
    rng = random.Random(3)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "Z9", "deadbeef" * 3, "0", "é", "\n", "a.b/c", "x", "-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["", None, "password=a token=abcdefg", "token=token=abcdef", "password: 'abc'"]
    rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)] + [(None, "secret = abcdefgh", None, None, None, None)] * 2 + [(7000 + i, *r[1:]) for i, r in enumerate(corpus)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = secrets.op11_secret_spans(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, slow_base(t or ""))
    for r in found:
        base = want[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in base) for k in KINDS[:3]), rows[r.doc_id or 0]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("literal")] == [s for s in joined(base).split(",") if s]
        keys = [(int(s.split(":")[1]), KINDS.index(s.split(":")[0])) for s in spans]
        assert keys == sorted(keys) and r.n_literal == sum(k == 3 for _, k in keys)


def found_texts(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in secrets.find_secrets(frame).collect():
        out[r.doc_id] = [r.text[s.start : s.end] for s in r.secrets if s.kind == "literal"]
    return [out[i] for i in range(len(texts))]


def test_planted_literals_in_every_form(spark):
    rng = random.Random(4)
    texts, want = [], []
    for form in FORMS:
        for name in NAMES:
            value = literal(rng)
            texts.append(f"{words(rng, 20)}\n{form.replace('NAME', name).replace('VALUE', value)}\n{words(rng, 20)}")
            want.append([value])
    got = found_texts(spark, texts)
    assert [(t, g) for t, g, w in zip(texts, got, want) if g != w] == []


def test_constants_reach_names(spark):
    texts = [
        'K = "q9X2-llm4Zp"\nx = 1\ndb_password = K', 'a = "q9X2" \nb = a + "-llm4Zp"\nself.password = b', 'password = token = "q9X2-llm4Zp"', 'K="q9X2-llm4Zp"\nDB_PASSWORD="${K}"', 'obj.k = "q9X2-llm4Zp"\npwd = obj.k',
        'K = "q9X2-llm4Zp"\nK = other()\ndb_password = K', 'K = "q9X2-llm4Zp"\ncolour = K', "postgres://bob:q9X2-llm4Zp@host/db", 'K = "q9X2-llm4Zp"\npwd = K\ntoken = K',
    ]
    one = ["q9X2-llm4Zp"]
    assert found_texts(spark, texts) == [one, ["q9X2", "-llm4Zp"], one, one, one, [], [], one, one]


def test_clean_texts_are_left_alone(spark):
    rng = random.Random(5)
    texts = [words(rng, 400) for _ in range(20)]
    texts += [
        "The password: everybody knows it.", 'password = "changeme"', "secret = os.environ['X1y2z3a4']", 'token_url = "https://host/A1b2C3d4"', "password = get_password()", 'title = "q9X2-llm4Zp"', "pwd = ${PWD}", "token: null",
        "Time: 10:30, ratio 3:4; see http://host/path?x=1", 'password = "four words stand here"', "if password == confirmation:", None, "", "=", '"', "password =",
    ]
    assert found_texts(spark, texts) == [[] for _ in texts]


def test_code_points_long_texts_and_odd_columns(spark):
    text = "é𝒳" * 200_000 + ' pwd = "q9X2-llm4Zp" ' + "word " * 200_000 + "a=" * 50_000 + "'" * 1001
    frame = spark.createDataFrame([(1, text, 5, 6), (1, text, 5, 6), (None, None, None, None)], "doc_id long, text string, SECRETS int, `a``b` int")
    found = secrets.find_secrets(frame)
    assert found.columns == ["doc_id", "text", "a`b", "secrets"]
    rows = {r.doc_id: r.secrets for r in found.collect()}
    assert [text[s.start : s.end] for s in rows[1]] == ["q9X2-llm4Zp"] and rows[None] == []
    assert secrets.find_secrets(frame.where("false")).collect() == []


@pytest.mark.parametrize("text", ["a.b" * 300_000, "x='" * 100_000, "a=" * 200_000, "a-" * 300_000, "http://" * 80_000, "a = a + a\n" * 2000 + "password = a", 'a = "xyzXYZ123"\n' + "a = a + a\n" * 3000 + "password = a", "a = b = " * 50_000])
def test_hostile_texts_take_linear_time(text):
    import time

    began = time.thread_time()
    found = list(secrets.pairs(text))
    assert time.thread_time() - began < 20 and sum(len(p.value) for p in found) < 4_000_000


def test_scores(spark):
    frame = spark.createDataFrame([("dbPassword", "x"), ("key", "x"), ("password_file", "x"), ("title", "x")], "n string, v string")
    assert [r[0] for r in frame.select(secrets.name_score(F.col("n"))).collect()] == [1.0, 0.6, 0.0, 0.0]


def test_literals_of_any_length_and_number_of_parts(spark):
    rng = random.Random(6)
    long, parts = "".join(literal(rng) for _ in range(800)), [literal(rng) for _ in range(100)]
    many = "password = " + " + ".join(f'"{p}"' for p in parts)
    named = "".join(f'k{i} = "{p}"\n' for i, p in enumerate(parts)) + "password = " + " + ".join(f"k{i}" for i in range(100))
    grown = 'a = "q9X2-llm4Zp"\n' + "a = a + a\n" * 300 + "password = a"
    words_only = 'password = "' + "four words stand here " * 400 + '"'
    texts = [f'password = "{long}"', many, named, grown, words_only, f'password = "{long}" + other()', many + ' + "(done)"']
    assert found_texts(spark, texts) == [[long], parts, parts, ["q9X2-llm4Zp"], [], [long], []]


def test_long_values_score_as_whole_ones(spark):
    rng = random.Random(7)
    ends = ["", "(", ")", "<", ">", "%", "{", "}", "$", "*", "...", "xxx", "\r", " ", " ", "change-me", "https://", "my ", "é", "A", "7"]
    values = [rng.choice(ends) + rng.choice(["x", "*", "ab", "aB3", "q 9", "(a)", "a\rb", "abcdefghijklmnop"]) * 400 + rng.choice(ends) for _ in range(400)]
    rows = spark.createDataFrame([(v, secrets.told(v)) for v in values], "a string, b string")
    assert rows.where(secrets.literal_score(F.col("a")) != secrets.literal_score(F.col("b"))).count() == 0 and max(len(secrets.told(v)) for v in values) <= 256


@pytest.mark.parametrize("text", ["a:b + " * 100_000, 'a = a + "x"\n' * 30_000, "c=1\n" + "c:b + c + " * 50_000, "a = b = " * 500 + '"x" + ' * 50_000])
def test_chains_take_linear_time_and_space(text):
    import time

    began, nodes = time.thread_time(), []
    found = list(secrets.pairs(text, nodes))
    assert time.thread_time() - began < 20 and sum(len(n.spans) + len(n.nodes) for n in nodes) < 2 * len(text) and all(len(p.value) <= 256 for p in found)
