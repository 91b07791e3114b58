import hashlib
import math
import random
import re

from tests.llm.util import documents, save
from vellum.llm.privacy import base_spans, find_private, luhn, sanitise
from vellum.llm.queries import op7

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # noqa: E741
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in E.finditer(t)] + [("ip", *m.span()) for m in I.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    return out + [("card", *m.span()) for m in C.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))] + [("phone", *m.span()) for m in P.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_spans():
    rng = random.Random(5)
    for letters in ("a1@.- +", "ab@.é@", "0123456789. -+()", "0.1.2", "5 4-", "a@b.c@d.e"):
        for _ in range(3000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert base_spans(t) == brute(t), t
    assert base_spans("0" * 200_000 + ".1.1.1") == [("ip", 0, 200_006)] and base_spans("a" * 300_000) == []


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    texts = [" ".join(word() for _ in range(30)) for _ in range(200)]
    told = [f"{word()} the wizardlike chairperson {a} writes" for a in ("joe@x.org",) for _ in range(6)]  # a term that goes with one entity
    common = [f"{word()} the everywhere person{i}@x.org writes everywhere" for i in range(40)]
    return texts + told + common + [None, "", "é +1 (706) 555-3138 漢 10.0.0.1 4111 1111 1111 1111", told[0], "x" * 50_000 + " a@b.cd"]


def test_query(spark, tmp_path):
    texts = corpus()
    got = {r.doc_id: r for r in op7.query(spark, save(spark, tmp_path, documents=documents(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want, r = brute(t or ""), got[i]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("term")) == listed
        terms = {(t or "")[int(a) : int(b)] for _, a, b in (s.split(":") for s in r.spans.split(",") if s.startswith("term"))}
        if t and "joe@" in t:
            assert {"wizardlike", "chairperson"} <= terms and "everywhere" not in terms
        else:
            assert not terms


def test_sql(spark, tmp_path):
    import duckdb

    d = save(spark, tmp_path, documents=documents(spark, corpus()))
    want = duckdb.connect().sql(op7.SQL.replace("FROM documents)", f"FROM '{d}/documents.parquet/*.parquet')"))
    got = sorted(tuple(r[c] for c in want.columns) for r in op7.query(spark, d).collect())
    assert got == sorted(want.fetchall()) and any("term" in r[-1] for r in got)


def test_sanitise(spark):
    texts = corpus()
    docs = documents(spark, texts).withColumnRenamed("lang", "spans")
    got = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert len(got) == len(texts) and sanitise(docs).columns == docs.columns
    for i, t in enumerate(texts):
        if not t or not brute(t):
            assert got[i] == t
        else:
            assert not brute(got[i])
        if t and "joe@" in t:
            assert "[EMAIL]" in got[i] and "wizardlike" not in got[i]
    assert sanitise(docs.where("false")).count() == find_private(docs.where("false")).count() == 0


def test_sanitise_everywhere(spark):
    """Disclosing terms go far from their entity, without it, and when they are short."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    texts = [" ".join(word() for _ in range(30)) for _ in range(200)] + [f"{word()} the Wizardlike Lee joe@x.org writes" for _ in range(12)]
    texts += [f"person{i}@x.org and the others" for i in range(40)] + ["joe@x.org " + "the " * 30 + "é wizardlike, Lee"]
    texts += ["漢 Lee the wizardlike", "+1 (706) 555-3138 wizardlike lee@x.org éwizardlike", "the leeward wizardlikes", None]
    docs = documents(spark, [(None if t and t.startswith("漢") else i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert len(got) == len(texts)
    far, away, other, whole, null = (got[i] for i in (len(texts) - 5, None, len(texts) - 3, len(texts) - 2, len(texts) - 1))
    # one entity only: its class would tell as much as its terms, so they are removed
    mark = lambda t: t.replace("[REMOVED]", "X")
    assert mark(far) == "[EMAIL] " + "the " * 30 + "é X, X" and mark(away) == "漢 X the X"
    assert mark(other) == "[PHONE] X [EMAIL] éwizardlike" and whole == texts[-2] and null is None
    assert all("Lee" not in got[i] and "the" in got[i] for i in range(200, 212))


def test_generalised_by_hand(spark):
    """Terms between the thresholds give way to the class of terms that go with the same kind of entity, by plain counting."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    texts = [" ".join(word() for _ in range(20)) for _ in range(300)]
    for k in range(10):
        texts += [f"{word()} painter{chr(97 + k)} writes from p{k}@x.org {word()}" for _ in range(4)]
        texts += [f"{word()} some painter{chr(97 + k)} {word()}" for _ in range(k % 4)]
    rng.shuffle(texts)
    got = {r.doc_id: r.text for r in sanitise(documents(spark, texts)).collect()}
    n = len(texts)
    for k in range(10):
        name, mail = f"painter{chr(97 + k)}", f"p{k}@x.org"
        n_e, n_t = sum(mail in t for t in texts), sum(name in t for t in texts)
        share = math.log2(n * n_e / (n_e * n_t)) / -math.log2(n_e / n)
        n_class = sum("painter" in t for t in texts)
        of_class = math.log2(n * n_e / (n_e * n_class)) / -math.log2(n_e / n)
        assert 0.8 <= share and of_class < 0.8
        for i, t in enumerate(texts):
            if name in t:
                want = "[REMOVED]" if share >= 0.95 else "[EMAIL TERM]"
                assert got[i] == t.replace(name, want).replace(mail, "[EMAIL]"), (got[i], t)
    assert any("[EMAIL TERM]" in t for t in got.values()) and any("[REMOVED]" in t for t in got.values())
    assert [got[i] for i, t in enumerate(texts) if "painter" not in t] == [t for t in texts if "painter" not in t]


def test_recall_by_kind(spark, tmp_path):
    """Every planted identifier of each kind is found, whatever stands around it but digits, which a card number would take in."""
    rng = random.Random(14)
    planted = {"email": "jo.e+x@mail.example.org", "ip": "192.168.10.255", "card": "4111 1111 1111 1111", "phone": "+49 (30) 901820-17"}
    rows, want = [], []
    for i in range(400):
        kind = rng.choice(list(planted))
        around = [rng.choice(["word", "é漢", "(", ",", "", "th", "\n"]) for _ in range(rng.randint(2, 8))]
        rows.append(" ".join(around) + " " + planted[kind] + " " + " ".join(around))
        want.append(kind)
    got = {r.doc_id: r for r in op7.query(spark, save(spark, tmp_path, documents=documents(spark, rows))).collect()}
    assert all(getattr(got[i], f"n_{kind}") == 1 for i, kind in enumerate(want))
