"""Token store, decontamination, line dedup, PII and packing against simple versions, and their odd cases."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate as dc
from tessera.llm import line_windows as lw
from tessera.llm import packing as pk
from tessera.llm import passages as ps
from tessera.llm import pii
from tessera.llm import textbytes as tb
from tessera.llm import token_store as ts
from tessera.llm.shared import least_hashed


def texts_of(seed, n=60):
    r = random.Random(seed)
    letters = "abcdé ,.\n'  \t1"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_words_and_grams():
    rows = ["Ab cd", "", "ef", "é_1-x", " y "]
    data, offsets = tb.text_bytes(pa.array([None, *rows]).slice(1))
    begin, end, text = tb.words(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(begin, end, strict=True)] == ["Ab", "cd", "ef", "é_1", "x", "y"]
    assert text.tolist() == [0, 0, 2, 3, 3, 4]
    h = tb.span_hashes(data, begin, end)
    assert len(set(h.tolist())) == 6
    again, o2 = tb.text_bytes(pa.array(["x ef"]))
    assert set(tb.span_hashes(again, *tb.words(again, o2)[:2]).tolist()) == {int(h[4]), int(h[2])}
    g, t = tb.ngrams(h, text, 2)
    assert t.tolist() == [0, 2, 3, 4]


def test_chunks_hold_every_row():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 50, "", "c"])})
    got = list(tb.chunks(batch, "text", 12))
    assert [t for part in got for t in part.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert list(tb.chunks(batch.slice(0, 0), "text")) == []


def test_least_hashed(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(3000)] + [(7, 5)] * 500 + [(None, 1)], "doc_id long, g int")
    got = least_hashed(df, "g", 20).collect()
    hashes = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(doc_id) as h").distinct().collect()}
    for g in (0, 1):
        want = sorted((i for i in range(3000) if i % 2 == g), key=hashes.get)[:20]
        assert sorted(r.doc_id for r in got if r.g == g) == sorted(want)
    assert [r.doc_id for r in got if r.g == 5] == [7]


def test_least_hashed_starts_no_python_worker(spark):
    named = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(300)], "doc_id long, lang string").localCheckpoint()
    for df, n in ((named, 20), (named, 0), (named.limit(0), 20)):
        got = least_hashed(df, "lang", n)
        assert got.schema["lang"].dataType.simpleString() == "string" and got.count() == (n * 2 if df is named else 0)
        assert "PythonRDD" not in got._jdf.queryExecution().toRdd().toDebugString()


# token store


def test_parts_join_to_the_same_ids():
    code = ts.encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    for t in [*texts_of(1), *texts_of(2), "a\x1cb !\x1c!", "  x", "x  ", "\n\n y", "it's  'll", "x　y", "a   b", "1 2  3", "​ x"]:
        assert np.frombuffer(code.serialized(t), code.dtype).tolist() == code.encoding.encode_ordinary(t), repr(t)


def test_round_trip_and_odd_rows(spark, tmp_path):
    rows = [(i, t, 1) for i, t in enumerate(texts_of(3, 40))] + [(None, "null id", 1), (90, None, 1), (91, "", 1), (92, "word " * 150_000, 1), (92, "word " * 150_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, payload int").repartition(3)
    store = ts.token_store(df, dictionary_bytes=1024)
    got = store.collect()
    (dictionary,) = [r for r in got if r.kind == "dictionary"]
    documents = [r for r in got if r.kind == "document"]
    assert len(documents) == len(rows) and {r.dictionary for r in documents} == {dictionary.dictionary}
    code = ts.encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    texts = {i: t for i, t, _ in rows}
    shards = {}
    for r in sorted((r for r in documents if r.payload is not None), key=lambda r: (r.shard, r.offset)):
        blob = shards.setdefault(r.shard, bytearray())
        assert len(blob) == r.offset
        blob += r.payload
    for r in documents:
        if r.payload is None:
            assert r.doc_id == 90 and r.n_bytes == 0 and r.n_tokens is None
            continue
        ids = ts.read_document(bytes(shards[r.shard]), r.offset, r.n_bytes, bytes(dictionary.payload))
        assert ids.tolist() == code.encoding.encode_ordinary(texts[r.doc_id]) and len(ids) == r.n_tokens
    ts.write_shards(store, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(got)
    assert [r.kind for r in ts.token_store(df.limit(0)).collect()] == ["dictionary"]


# decontamination


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_is_right():
    r = random.Random(0)
    for _ in range(300):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 70)))
        text = "".join(r.choice("abc ") for _ in range(r.randint(0, 90)))
        assert dc.best_distance(item, text) == plain_distance(item, text)


def test_decontamination_is_that_of_all_comparisons(spark):
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "ño", "x"]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for k in range(12)] + [(50, None), (51, ""), (None, "alpha"), (52, "--- ***")]
    docs = []
    for i in range(50):
        w = [r.choice(words) for _ in range(r.randint(0, 20))]
        if i % 2:
            t = list(items[r.randrange(12)][1])
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice("abcq,")
            w.insert(r.randint(0, len(w)), "".join(t))
        docs.append((i, (" ".join(w)).upper() if i % 3 else ", ".join(w)))
    docs += [(90, None), (91, ""), (None, items[3][1]), (92, "pad " * 60_000 + items[3][1]), (93, items[3][1]), (93, items[3][1])]
    want = {}
    for i, t in docs:
        for k, item in items:
            if i is None or k is None or not t or not item or not dc.normal(item) or i == 92:
                continue
            d, budget = plain_distance(dc.normal(item), dc.normal(t)), len(dc.normal(item)) // 16
            if d <= budget:
                want[i, k] = d
    df = spark.createDataFrame([(*x, 0, 0) for x in docs], "doc_id long, text string, item_id int, distance int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in dc.contaminated(df, bench).collect()}
    assert {k: v for k, v in got.items() if k[0] != 92} == want and got[92, 3] == 0
    assert {(x.doc_id, x.item_id): x.distance for x in dc.contaminated(df, bench, pass_bytes=200).collect()} == got
    kept = dc.decontaminated(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got} - {None}
    assert sorted(x.doc_id for x in dc.decontaminated(df, bench, pass_bytes=200).collect()) == sorted(x.doc_id for x in kept.collect())
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0


# line dedup


def plain_dedup(docs):
    seen, gone = set(), {}
    for i, t in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0)):
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" ")]
        for a, b, c in zip(at, at[1:], at[2:], strict=False):
            key = tuple(lines[k].strip(" ") for k in (a, b, c))
            if key in seen:
                gone.setdefault((i, t), set()).update((a, b, c))
            seen.add(key)
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for i, t in docs if t is not None}


def test_line_dedup_is_the_plain_one(spark):
    r = random.Random(2)
    docs = [(i, "\n".join(r.choice(["a", "b", " b ", "c", "", "d"]) for _ in range(r.randint(0, 14)))) for i in range(50)]
    docs += [(None, "a\nb\nc\nd"), (70, None), (71, ""), (72, "one\ntwo"), (73, "u\nv\nw\n" * 20_000), (74, "z\ny\nx"), (74, "z\ny\nx"), (75, "z\ny\nx")]
    df = spark.createDataFrame([(i, t, 9, 9, "g") for i, t in docs], "doc_id long, text string, row int, n_chars int, gone string")
    got = lw.without_repeated_windows(df).collect()
    want = plain_dedup(docs)
    assert len(got) == len(docs)
    assert sorted((r.doc_id or -1, r.text) for r in got if r.text is not None) == sorted((i or -1, want[i, t]) for i, t in docs if t is not None)
    assert [r.text for r in got if r.doc_id in (74, 75)].count("z\ny\nx") == 2
    changed = [r for r in got if r.removed_lines]
    assert changed and all(r.n_chars == len(r.text) for r in changed) and [(r.removed_lines, r.left_lines) for r in got if r.doc_id == 70] == [(None, None)]
    assert lw.without_repeated_windows(df.limit(0)).count() == 0


# passages


def plain_passages(docs):
    seen, gone = {}, {}
    for i, t in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0)):
        w = re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", t)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), (i, t, k)) != (i, t, k):
                gone.setdefault((i, t), set()).update(range(k, k + 50))
    left = {}
    for i, t in docs:
        if t is not None:
            w = re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", t)
            left[i, t] = [x for k, x in enumerate(w) if k not in gone.get((i, t), ())]
    return left


@pytest.mark.parametrize("dedup", [lw.without_repeated_windows, ps.without_repeated_passages])
def test_rows_of_one_key_keep_their_own_lines(spark, monkeypatch, dedup):
    """Where the keys of two rows collide, each loses only what it repeats itself."""
    from pyspark.sql import functions as F

    for module in (lw, ps):
        monkeypatch.setattr(module, "row_key", lambda *cols: F.lit(5).cast("long"))
    lines = ["a\nb\nc\nd", "u\nv\nw\nx", "a\nb\nc\nq"]
    if dedup is ps.without_repeated_passages:
        lines = [" ".join(f"{c}{i}" for i in range(60)) for c in ("a", "b")] + [" ".join(f"a{i}" for i in range(50)) + " q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup(df).collect()}
    assert got == {0: lines[0], 1: lines[1], 2: "q"}


def test_passages_are_the_plain_ones(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé1") for _ in range(3))
    pool = [[word() for _ in range(r.randint(49, 80))] for _ in range(6)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 120))]
        for _ in range(i % 3):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(pool)
        docs.append((i, "".join(x + r.choice([" ", " ", ". ", "\n"]) for x in w)))
    docs += [(None, " ".join(pool[0])), (80, None), (81, ""), (82, "and " * 300), (83, "x y z " * 30_000), (84, " ".join(pool[1])), (84, " ".join(pool[1])), (85, " ".join(pool[2]))]
    df = spark.createDataFrame([(i, t, 9, 9, "g") for i, t in docs], "doc_id long, text string, row int, n_chars int, new string").repartition(3)
    want = plain_passages(docs)
    for most in (ps.BROADCAST_ITEMS, 0):
        monkeypatch.setattr(ps, "BROADCAST_ITEMS", most)
        got = ps.without_repeated_passages(df).collect()
        assert len(got) == len(docs) and [r.removed_words for r in got if r.doc_id == 80] == [None]
        assert sorted((r.doc_id or -1, re.findall(r"\w+", r.text)) for r in got if r.text is not None) == sorted((i or -1, want[i, t]) for i, t in docs if t is not None)
        assert sum(bool(r.removed_words) for r in got) > 20 and all(r.n_chars == len(r.text) for r in got if r.removed_words)
    assert ps.without_repeated_passages(df.limit(0)).count() == 0


def test_passage_within_lines(spark):
    import corpus_pipeline as cp

    r = random.Random(6)
    own = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = own(54)
    docs = [(1, f"{own(150)} {passage.replace(' ', chr(10), 1)} {own(9)}"), (2, f"One line {passage}\n{own(200)}"), (3, own(60)), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r.removed_lines for r in lw.without_repeated_windows(df).orderBy("doc_id").collect()] == [0, 0, 0, None]
    got = {r.doc_id: r.text for r in cp.near_duplicates(spark, df, "").collect()}
    assert got == {**dict(docs), 2: docs[1][1].replace(passage, "")}


# PII


@pytest.mark.parametrize(
    ("text", "kind", "source", "value"),
    [
        ("mail bob.x@mail.example.com now", "email", "bob.x@mail.example.com", "bob.x@mail.example.com"),
        ("mail bob (at) mail [dot] example {dot} com.", "email", "bob (at) mail [dot] example {dot} com", "bob@mail.example.com"),
        ("write to bob at mail dot example dot com please", "email", "bob at mail dot example dot com", "bob@mail.example.com"),
        ("Bоb@mаil.com ok", "email", "Bоb@mаil.com", "bob@mail.com"),
        ("ｂｏｂ＠ｍａｉｌ．ｃｏｍ", "email", "ｂｏｂ＠ｍａｉｌ．ｃｏｍ", "bob@mail.com"),
        ("call five five five, zero one zero zero one two three today", "phone", "five five five, zero one zero zero one two three", "5550100123"),
        ("call +1 (626) 555-5759 éé", "phone", "+1 (626) 555-5759", "+16265555759"),
        ("tel +۱ (۶۲۶) ۵۵۵-۵۷۵۹", "phone", "+۱ (۶۲۶) ۵۵۵-۵۷۵۹", "+16265555759"),
        ("card 4111 1111 1111 1111.", "card", "4111 1111 1111 1111", "4111111111111111"),
        ("ip 10.0.200.3.", "ip", "10.0.200.3", "10.0.200.3"),
        ("ssn 123-45-6789", "ssn", "123-45-6789", "123-45-6789"),
        ("iban DE89 3704 0044 0532 0130 00", "iban", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"),
        ('token = "0641917ea4e9feb9" x', "secret", 'token = "0641917ea4e9feb9', "0641917ea4e9feb9"),
    ],
)
def test_pii_kinds(text, kind, source, value):
    for lead in ("", "é ünd ", "x" * 40 + " "):
        got = pii.spans(lead + text)
        assert [(k, s, v) for k, _, _, s, v in got] == [(kind, source, value)]
        assert (lead + text)[got[0][1] : got[0][2]] == source


def test_pii_leaves_clean_text():
    for t in ("meet at noon, one two", "v1.2.3.4.5 of 300.1.1.1", "the dot at one", "order 12345", "a@b", "it is at home (at last)", "", "ref 3668798256337530 and 4929963689861573", "two dots .. at 4"):
        assert pii.spans(t) == []


def plain_emails(text):
    """Addresses by trying every span of text."""
    ok = set("abcdefghijklmnopqrstuvwxyz0123456789")

    def label(x):
        return x and x[0] in ok and x[-1] in ok and set(x) <= ok | {"-"}

    def host(x):
        *rest, top = x.split(".")
        return rest and all(map(label, rest)) and len(top) >= 2 and top.isalpha()

    out = []
    for at in (k for k, c in enumerate(text) if c == "@"):
        starts = [a for a in range(at) if set(text[a:at]) <= ok | set("._%+-") and text[a] not in ".-"]
        ends = [b for b in range(at + 2, len(text) + 1) if host(text[at + 1 : b])]
        if starts and ends and all(b <= starts[0] for _, b in out):
            out.append((starts[0], ends[-1]))
    return out


def plain_addresses(text):
    """IP addresses by trying every span of text."""
    spans = [(a, b) for a in range(len(text)) for b in range(a + 7, min(len(text), a + 15) + 1)]
    fits = lambda x: len(p := x.split(".")) == 4 and all(d.isdigit() and len(d) <= 3 and int(d) < 256 for d in p)
    return [(a, b) for a, b in spans if fits(text[a:b]) and (a == 0 or text[a - 1] not in "0123456789.") and not text[b : b + 1].isdigit() and not (text[b : b + 1] == "." and text[b + 1 : b + 2].isdigit())]


def test_pii_by_brute_force():
    r = random.Random(11)
    for _ in range(3000):
        text = "".join(r.choice("aab1.@-_ ") for _ in range(r.randint(0, 30)))
        assert [(a, b) for k, a, b, *_ in pii.spans(text) if k == "email"] == plain_emails(text), text
        text = "".join(r.choice(["1", "2", "25", "255", "256", ".", ".", ".", " "]) for _ in range(r.randint(0, 20)))
        assert [(a, b) for k, a, b, _ in pii.identifiers(text) if k == "ip"] == plain_addresses(text), text


def test_pii_round_trip():
    """Identifiers are disguised at random and set among words; each is found at its place, with its plain value."""
    r = random.Random(12)
    like = {v: k for k, v in pii._LIKE.items() if v.isalnum() and v.isascii() and len(v) == 1}
    words = {str(i): w for i, w in enumerate("zero one two three four five six seven eight nine".split())}

    def card():
        head = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(head + d for d in "0123456789" if pii.luhn(head + d))

    for _ in range(400):
        source, want = "", []
        for _ in range(r.randint(0, 5)):
            source += " ".join(r.choice(["river", "stone", "éà", "at", "dot"]) for _ in range(r.randint(1, 4))).removesuffix("dot").removesuffix("at") + " x; "
            kind = r.choice(["email", "card", "phone", "ip"])
            value = {"email": f"ab{r.randint(0, 99)}@mail{r.randint(1, 9)}.example.com", "card": card(), "phone": f"{r.randint(200, 999)}555{r.randint(1000, 9999)}", "ip": f"10.{r.randint(0, 255)}.{r.randint(0, 255)}.7"}[kind]
            shown = value
            if kind == "email" and r.random() < 0.5:
                shown = shown.replace("@", r.choice([" (at) ", "[at]", " <@> "])).replace(".", r.choice([" [dot] ", "(dot)", "{.}"]))
            elif kind == "phone":
                shown = r.choice([" ".join(words[c] for c in value), "-".join((value[:3], value[3:6], value[6:]))])
            elif kind == "card" and r.random() < 0.5:
                shown = " ".join(value[i : i + 4] for i in range(0, 16, 4))
            if r.random() < 0.4 and not any(w in shown for w in words.values()):
                shown = "".join(like.get(c, c) if r.random() < 0.3 and "(" not in shown and "[" not in shown and "{" not in shown and "<" not in shown else c for c in shown)
            want.append((kind, len(source), len(source) + len(shown), shown, value))
            source += shown + " ; "
        assert pii.spans(source) == want, source


@pytest.mark.parametrize("text", ["one two" + " " * 1_000_000 + "x", "(" + " " * 1_000_000, "( " * 500_000, "ab@mail.com " * 80_000, "one two three " * 70_000, "a at b dot c " * 80_000, "a" * 1_000_000 + "@mail.com", "@a." * 300_000, "@a" + "-" * 1_000_000, "1 " * 500_000, "token " * 160_000 + "=", "one " * 250_000 + "onex"])
def test_pii_takes_long_texts(text):
    began = time.thread_time()
    found = pii.spans(text)
    assert time.thread_time() - began < 5
    assert {s for *_, s, _ in found} <= {"ab@mail.com", "a" * 1_000_000 + "@mail.com"}
    assert len(found) == text.count("@mail.com")


def test_pii_rows(spark):
    text = "one@mail.com and two (at) mail (dot) com, three@mail.com"
    df = spark.createDataFrame([(1, text, "k"), (1, text, "k"), (None, text, "k"), (2, None, "k"), (3, "", "k"), (4, "pad " * 100_000 + text, "k")], "doc_id long, text string, kind string")
    got = pii.personal_data(df).collect()
    assert len(got) == 12 and [r.value for r in got if r.doc_id is None] == ["one@mail.com", "two@mail.com", "three@mail.com"]
    assert all(("pad " * 100_000 + text)[r.start : r.end] == r.source for r in got if r.doc_id == 4)
    assert pii.personal_data(df.limit(0)).count() == 0


# packing


def plain_ffd(sizes, capacity):
    room, out = [], []
    for s in sizes:
        k = next((k for k, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= s
        out.append(k)
    return out


def test_tournament_is_first_fit():
    r = random.Random(3)
    for _ in range(60):
        capacity = r.randint(1, 40)
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 80))]
        assert pk.first_fit_decreasing(sizes, capacity) == plain_ffd(sizes, capacity)


def test_packing_rows(spark):
    r = random.Random(4)
    docs = [(i, "w " * r.randint(0, 25)) for i in range(200)] + [(None, "a b"), (300, None), (301, ""), (302, "w " * 70_005), (303, "q r"), (303, "q r")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, size int")
    bins = pk.packed(df, 20, 50).collect()
    pieces = [(i, s, n) for b in bins for i, s, n in zip(b.doc_ids, b.starts, b.sizes, strict=True)]
    want = [(i, s, min(20, len(t.split()) - s)) for i, t in docs if t for s in range(0, len(t.split()), 20)]
    key = lambda p: (p[0] or -1, p[1], p[2])
    assert sorted(pieces, key=key) == sorted(want, key=key)
    assert len({b.pack for b in bins}) > 1 and all(b.used == sum(b.sizes) <= 20 for b in bins)
    for pack in {b.pack for b in bins}:
        own = sorted((b for b in bins if b.pack == pack), key=lambda b: b.bin)
        items = sorted(((n, 10**9 if i is None else i, s, b.bin) for b in own for i, s, n in zip(b.doc_ids, b.starts, b.sizes, strict=True)), key=lambda x: (-x[0], x[1], x[2]))
        assert [x[3] for x in items] == plain_ffd([x[0] for x in items], 20) or len({x[:3] for x in items}) < len(items)
    assert pk.packed(df.limit(0)).count() == 0
    same = spark.createDataFrame([(None, f"{'w ' * 3}{i}") for i in range(400)] + [(7, "a b c d")] * 1600, "doc_id long, text string")
    bins = pk.packed(same, 20, 50).collect()
    assert sum(len(b.doc_ids) for b in bins) == 2000 and sum(i == 7 for b in bins for i in b.doc_ids) == 1600
    assert max(sum(len(b.doc_ids) for b in bins if b.pack == p) for p in {b.pack for b in bins}) < 150
