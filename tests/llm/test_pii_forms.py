"""Secrets as documents write them, and names of more than two plain words."""

import random
import re

from pyspark.sql import functions as F

from stocktide.llm import pii

HEX = re.compile(r'(?:token|TOKEN) = "([0-9a-fA-F]{40})"')


def test_assigned_secrets_of_documents(spark, sf):
    rows = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").where(F.col("text").rlike('(?i)token = "')).collect()
    secrets = {x for r in rows for x in HEX.findall(r.text)}
    assert secrets
    new = {r.doc_id: r.text for r in pii.replace_in(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert not any(x in t for x in secrets for t in new.values())
    assert sum(len(HEX.findall(r.text)) for r in rows) == sum(len(HEX.findall(t)) for t in new.values())


def test_other_secrets(spark, docs):
    lone, b64 = "0123456789abcdef" * 2, "aB3/" * 11
    got = [r.text for r in pii.replace_in(docs([(1, f"x {lone} and token='{lone}' and {b64}== y"), (2, 'password: "correct-horse"'), (3, "a key: the word")]), "k").orderBy("doc_id").collect()]
    m = re.fullmatch(r"x ([0-9a-f]{32}) and token='([0-9a-f]{32})' and (\S{44})== y", got[0])
    assert m[1] == m[2] != lone and m[3] != b64
    assert re.fullmatch(r'password: "[a-z]{7}-[a-z]{5}"', got[1]) and "correct" not in got[1] and got[2] == "a key: the word"


def test_names_of_many_parts(docs):
    texts = ["Mr. John Paul Smith came", "Mrs. Anna Smith-Jones came", "Mr. J. Smith came", "Herr Karl von der Berg came"]
    a, b, c, d = (r.text for r in pii.replace_in(docs(list(enumerate(texts))), "k").orderBy("doc_id").collect())
    w = r"[A-Z][a-z]+"
    a, b = re.fullmatch(rf"Mr\. {w} {w} ({w}son) came", a), re.fullmatch(rf"Mrs\. {w} ({w}son)-{w}son came", b)
    c, d = re.fullmatch(rf"Mr\. [A-Z]\. ({w}son) came", c), re.fullmatch(rf"Herr {w} von der {w}son came", d)
    assert d and a[1] == b[1] == c[1] != "Smith"


def _made(docs, texts, key="k"):
    return [r.text for r in pii.replace_in(docs(list(enumerate(texts))), key).orderBy("doc_id").collect()]


def test_one_name_in_all_its_forms(docs):
    """Possessives, a capital word after the name, other titles, several blanks and none: all of them Smith."""
    texts = ["Mr. Smith met", "Mr. Smith's dog", "Mr. Smith Yesterday left", "Dr. Smith met", "Mr.  Smith met", "Prof.\u00a0Smith met", "Mx Smith’s dog", "Mr. John Smith met", "Smiths’ end", "Mrs. O'Brien's cat", "Mrs O'Brien met"]
    got = _made(docs, texts)
    names = [re.search(r"([A-Z][a-z]+son)", x)[1] for x in got[:8]]
    assert len(set(names)) == 1 and names[0] != "Smith" and "Smith" not in " ".join(got[:8])
    assert got[1] == f"Mr. {names[0]}'s dog" and got[2] == f"Mr. {names[0]} Yesterday left" and got[4] == f"Mr.  {names[0]} met" and got[6] == f"Mx {names[0]}’s dog"
    assert got[8] == texts[8] and re.fullmatch(r"Mrs\. (\w+)'s cat", got[9])[1] == re.fullmatch(r"Mrs (\w+) met", got[10])[1]


def test_a_name_has_one_kind(docs):
    """A given name of no known gender has the one it has elsewhere; a name that is a family name somewhere is one everywhere."""
    a, b, c, d = _made(docs, ["Dr. Anna Berg met", "Mrs. Anna Berg met", "Mr. Paul Kant met", "Mr. Otto Paul met"])
    assert re.fullmatch(r"Dr\. (\w+a \w+son) met", a)[1] == re.fullmatch(r"Mrs\. (\w+a \w+son) met", b)[1]
    assert re.fullmatch(r"Mr\. (\w+son) \w+son met", c)[1] == re.fullmatch(r"Mr\. \w+n (\w+son) met", d)[1]


def _mod97(iban):
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_ibans_stay_valid(docs):
    good = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"]
    got = [re.fullmatch(r"to (.*) now", x)[1] for x in _made(docs, [f"to {x} now" for x in [*good, "DE00370400440532013000"]])]
    for old, new in zip(good, got):
        assert new != old and new[:2] == old[:2] and _mod97(new) == 1 and re.sub("[0-9]", "0", new[4:]).translate({ord(c): "A" for c in map(chr, range(65, 91))}) == re.sub("[0-9]", "0", old[4:]).translate({ord(c): "A" for c in map(chr, range(65, 91))})
    assert got[3][:2] == "DE" and len(got[3]) == 22


def test_more_names_than_three_syllables_give(spark, monkeypatch):
    """Later attempts draw longer names: no tag, all distinct, type and script kept."""
    monkeypatch.setitem(pii._SCRIPTS, "Latin", (["ba", "ce"], "n", "a", "i", "son"))
    names = [a + b + c for a in ("Kor", "Lum", "Vex", "Zam") for b in ("al", "eb", "ic", "od") for c in ("um", "ys", "ex")]
    got = [r.surrogate for r in pii.surrogates(spark.createDataFrame([(f"Mr. {n}",) for n in names], "entity string"), "k").collect()]
    assert len(set(got)) == len(names) and all(re.fullmatch(r"Mr\. [A-Z][a-z]+son", x) for x in got)


def test_the_key_is_in_no_plan(docs):
    df = pii.replace_in(docs([(1, "a@b.org and Mr. Smith")]), "a-very-secret-key")
    for plan in (df._jdf.queryExecution().toString(), df._jdf.queryExecution().executedPlan().toString()):
        assert "a-very-secret-key" not in plan and not re.search("Python|Pandas|Arrow", plan)


def test_rows_without_an_id_keep_their_own_entities(docs):
    rows = [(None, f"mail m{k}.x@host{k}.org now") for k in range(300)] + [(7, "Mr. Kant"), (7, "Mrs. Berg")]
    got = [r.text for r in pii.replace_in(docs(rows), "k").collect()]
    assert len(got) == len(set(got)) == 302 and all(re.fullmatch(r"mail [a-z]\d{1,3}\.[a-z]@[a-z]{4}\d{1,3}\.org now|Mrs?\. \w+son", x) for x in got)


def test_planted_entities(docs):
    """All planted entities go, nothing else changes, and one entity has one surrogate wherever it stands."""
    r = random.Random(12)
    fill = "the quick fox saw 12 items for 3.50 at noon and went on to read chapter 7 of a long book".split()
    mails = [f"user{k}.name@mail{k % 5}.example.org" for k in range(20)]
    phones = [f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}" for _ in range(20)]
    people = [f"{r.choice(['Mr.', 'Mrs.', 'Dr.'])} {r.choice(['Alma', 'Boris', 'Clara'])} {x}" for x in ("Adler", "Brook", "Cole", "Dunn", "Ebert", "Finch")]
    addresses = [f"{r.randint(1, 223)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}" for _ in range(20)]
    planted, texts = [], []
    for _ in range(150):
        own, words = [r.choice(r.choice([mails, phones, people, addresses])) for _ in range(r.randint(0, 3))], []
        for e in own:
            words += [r.choice(fill) for _ in range(r.randint(1, 9))] + [e]
        planted.append(own)
        texts.append(words + [r.choice(fill) for _ in range(3)])
    of = {}
    for own, words, new in zip(planted, texts, _made(docs, [" ".join(w) for w in texts])):
        pattern = " ".join("(.+?)" if w in own else re.escape(w) for w in words)
        m = re.fullmatch(pattern, new)
        assert m, (words, new)
        for e, s in zip([w for w in words if w in own], m.groups()):
            assert s != e and of.setdefault(e, s) == s
    assert len(set(of.values())) == len(of)
