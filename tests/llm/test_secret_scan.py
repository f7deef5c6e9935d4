import hashlib
import random
import string

from shelfspark.llm import secret_scan

RNG = random.Random(9)
HEX = "0123456789abcdef"


def token(alphabet, n):
    return "".join(RNG.choice(alphabet) for _ in range(n))


def fixture(n=240):
    words = ["".join(RNG.choice(["en", "ther", "ing", "ach", "lich", "tion"]) for _ in range(RNG.randint(1, 4))) for _ in range(200)]
    docs, secrets = [], {}
    for i in range(n):
        w = [RNG.choice(words) for _ in range(RNG.randint(5, 60))]
        at = RNG.randint(1, len(w))
        if i % 6 == 0:
            value = "AKIA" + token(string.ascii_uppercase + string.digits, 16)
            w.insert(at, value)
        elif i % 6 == 1:
            value = token(HEX, 18) + "1a2"
            w.insert(at, f"password={value}")
        elif i % 6 == 2:
            value = token(HEX, 38) + "77"
            w[at:at] = ["token", "=", f'"{value}"']
        else:
            value = None
            w.insert(at, RNG.choice(["enlichtheringachenther", "commit " + token(HEX, 40), "internationalisierungen"]))
        docs.append((i, " ".join(w), f"src{i % 3}"))
        secrets[i] = value
    return docs, secrets


DOCS, SECRETS = fixture()


def frame(spark, extra=()):
    rows = [(i, t, s, len(t or ""), "v") for i, t, s in [*DOCS, *extra]]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, value string")


def test_finds_planted_secrets_and_nothing_else(spark):
    extra = [(900, None, None), (901, "", "x"), (902, "word " * 30_000, "x"), (0, DOCS[0][1], "src0"), (None, "password=abcdef0123456789ab", None)]
    found = secret_scan.scan(frame(spark, extra)).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).add(r.value)
    expected = {i: {v} for i, v in SECRETS.items() if v} | {None: {"abcdef0123456789ab"}}
    assert got == expected
    assert sum(r.doc_id == 0 for r in found) == 2
    by = {r.doc_id: r for r in found}
    assert by[1].kind == "named" and by[0].kind == "provider" and 0 <= min(r.score for r in found)
    assert DOCS[1][1].split()[by[1].word].endswith(SECRETS[1])


def test_report_hides_values_and_redact_keeps_rows(spark):
    df = frame(spark, [(900, None, None), (901, "", "x")])
    report = {r.doc_id: r.value_sha256 for r in secret_scan.report(df).collect()}
    assert report[0] == hashlib.sha256(SECRETS[0].encode()).hexdigest()
    clean = secret_scan.redact(df)
    assert clean.columns == df.columns and clean.dtypes == df.dtypes
    texts = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    for i, t, _ in DOCS:
        expected = t.replace(SECRETS[i], secret_scan.REDACTED) if SECRETS[i] else t
        assert texts[i] == (expected, len(expected))
    assert texts[900] == (None, 0) and texts[901] == ("", 0)


def test_no_findings(spark):
    for df in (frame(spark).limit(0), frame(spark).filter("doc_id = 3")):
        assert secret_scan.scan(df).collect() == []
        assert secret_scan.redact(df).count() == df.count()


def test_own_labels_and_native_plan(spark):
    df = frame(spark)
    found = secret_scan.features(secret_scan.candidates(df), secret_scan.dictionary(df))
    labelled = found.withColumn("label", secret_scan.rule_label(found))
    assert {r.value for r in secret_scan.scan(df, labelled).collect()} == {v for v in SECRETS.values() if v}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    row = found.filter("value like 'AKIA%'").first()
    assert row.length == 20 and abs(row.digits + row.uppers - 1) < 1e-9 and row.hex_only == 0


PASSWORDS = [('login password="Tr0ub4dor&3" ok', "Tr0ub4dor&3"), ("pwd: hunter2!x then", "hunter2!x"), ("the password = P@ss.w0rd!Long$one, see", "P@ss.w0rd!Long$one"),
             ("{\"db_password\": \"my dog's 3 legs\", \"a\": 1}", "my dog's 3 legs"), ("secret='aB3$' x", "aB3$"), ("user x\npassword:\n  hunter2\n", "hunter2"),
             ("password=é1ü2 end", "é1ü2"), ('a passwd => "x\\"y7" b', 'x\\"y7'), ("id 7 password: k9#z", "k9#z")]


def test_short_and_punctuated_passwords(spark):
    extra = [(1000 + i, t, "x") for i, (t, _) in enumerate(PASSWORDS)]
    extra += [(2000, "the secret: nothing", "x"), (2001, "password: <your password>", "x"), (2002, "password = getenv('DB_PASS1')", "x")]
    df = frame(spark, extra + extra[:1])
    found = [r for r in secret_scan.scan(df).collect() if r.doc_id >= 1000]
    assert sorted((r.doc_id, r.value) for r in found if r.doc_id < 2000) == sorted([(1000 + i, v) for i, (_, v) in enumerate(PASSWORDS)] + [(1000, PASSWORDS[0][1])])
    assert not [r for r in found if r.doc_id > 2000]
    assert all(PASSWORDS[r.doc_id - 1000][0].split()[r.word].strip("\"',").endswith(r.value.split()[0].strip("\"'")) for r in found if r.doc_id < 2000)
    texts = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    for i, (t, v) in enumerate(PASSWORDS):
        assert texts[1000 + i] == t.replace(v, secret_scan.REDACTED)


def test_only_the_place_is_redacted(spark):
    rows = [(3000, "password=12c4 call 0612c45678 or room 12c40, 12c4"), (3001, " x\n token: 'ab12 cd34ef'\tthen ab12 "), (3002, "nothing here")]
    df = frame(spark, [(i, t, "x") for i, t in rows]).withColumnsRenamed({"value": "secrets", "source": "doc"})
    texts = {r.doc_id: r.text for r in secret_scan.redact(df).filter("doc_id >= 3000").collect()}
    assert texts[3000] == "password=[REDACTED] call 0612c45678 or room 12c40, 12c4"
    assert texts[3001] == " x\n token: '[REDACTED]'\tthen ab12 " and texts[3002] == "nothing here"


def test_sample_words_have_borders():
    import re

    inside = ["latest", "contest1", "samples", "protested", "examples"]
    assert not any(re.search(secret_scan._SAMPLE, w) for w in inside)
    assert all(re.search(secret_scan._SAMPLE, w) for w in ["test", "a-test-b", "KEY7EXAMPLE", "sample", "xxxxxxxx", "my_dummy"])
