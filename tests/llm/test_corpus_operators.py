"""The corpus operators on awkward tables, against brute force, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from types import SimpleNamespace

import pytest
import xxhash
from pyspark.sql import functions as F
from test_corpus_units import plain_weak_supervision

import corpus_pipeline
from parley.llm import common, decontam, langid, neardup, pieces, pii, quality, secrets, spans, telephony, toxicity
from parley.llm import queries as q

EXTRA = ", score double, _text string, text_ string, k1 string, h string, class_id string, words string, media string, tag string, drop string"


def documents(spark, rows, extra=True):
    """(doc_id, text) rows with columns whose names operators use themselves."""
    more = (0.5, *["x"] * 9) if extra else ()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + (EXTRA if extra else "")
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *more) for i, t in rows], schema)


WORDS = random.Random(7)
VOCABULARY = ["".join(WORDS.choices("abcdefghijkl", k=WORDS.randrange(2, 9))) for _ in range(400)]


def prose(seed, n=60):
    rng = random.Random(seed)
    out = []
    while n > 0:
        k = min(n, rng.randrange(6, 12))
        out.append(" ".join(rng.choices(VOCABULARY, k=k)).capitalize() + ".")
        n -= k
    return " ".join(out)


LONG = prose(99, 20_000)
AWKWARD = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, prose(1)), (6, prose(1)), (6, prose(1)), (7, "🙂 ümlaut 다중"), (8, LONG), (None, prose(2)), (None, None), (9, "\x00\x07")]


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, []).cache()


def check(df, n=len(AWKWARD)):
    rows = df.collect()
    assert len(rows) == n
    return rows


def test_telephony(awkward, empty):
    def run(docs):
        stored = telephony.store(docs, F.coalesce("text", F.lit("")).cast("binary"), F.col("doc_id"))
        return telephony.decode(stored, F.col("media"), F.col("doc_id"), F.col("n_bytes"), keep=("codes", "pcm"))

    texts = {i: t or "" for i, t in AWKWARD if i}
    for r in check(run(awkward)):
        if r.doc_id:
            raw = texts[r.doc_id].encode()
            payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
            assert (r.n_bytes, bytes(r.codes)) == (len(raw), payload)
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
            assert len(r.pcm) == 2 * r.n_samples and r.pcm_crc32 == zlib.crc32(bytes(r.pcm))
    check(run(empty), 0)
    nothing = telephony.decode(awkward, F.lit(None).cast("binary"), F.col("doc_id"))
    assert all(r.codec is None for r in check(nothing))


def test_scores(spark, awkward, empty):
    good, bad = [prose(i) for i in range(40)], [prose(i) + " You moron. " + prose(i, 10) for i in range(40)]
    toxic = toxicity.fit(good + bad, [0] * 40 + [1] * 40)
    fine = quality.fit(good, good + [b.replace(".", " &&& &&&") for b in bad[:10]])
    for docs, n in ((awkward, len(AWKWARD)), (empty, 0)):
        assert all(0 <= r.score <= 1 for r in check(toxicity.score(docs, F.col("text"), F.col("doc_id"), model=toxic), n))
        assert all(0 <= r.score <= 1 for r in check(quality.score(docs, F.col("text"), F.col("doc_id"), model=fine), n))


def test_languages(spark, awkward, empty):
    docs = documents(spark, [(i, prose(i)) for i in range(30)])
    rows = langid.sample(docs, common.crc_bucket(F.col("doc_id"), 5) != 0, 10)
    assert 1 <= len(rows) <= 20 and all(lang == "en" for _, lang in rows)
    model = langid.fit([t for t, _ in rows], [x for _, x in rows])
    got = check(langid.identify(awkward, F.col("text"), F.col("doc_id"), model=model))
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 9)} == {"und"}
    check(langid.identify(empty, F.col("text"), F.col("doc_id"), model=model), 0)
    assert langid.sample(empty, F.lit(True), 10) == []


def test_labelled_sample_is_bounded_and_ignores_held_out_rows(spark):
    docs = documents(spark, [(i, f"t{i}") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    rows = common.labelled_sample(docs, labels, "toxic", common.crc_bucket(F.col("doc_id"), 5) != 0, 8)
    assert sorted(y for _, y in rows) == [0] * 8 + [1] * 8
    assert all(zlib.crc32(t[1:].encode()) % 5 for t, _ in rows)


def test_samples_are_bounded_where_an_id_repeats(spark):
    docs = documents(spark, [(1, f"t{i % 700}") for i in range(3000)] + [(2, "u" * 3000), (3, "v"), (4, "w")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, 0)], "doc_id bigint, toxic int")
    assert sorted(common.labelled_sample(docs, labels, "toxic", F.lit(True), 5)) == [("t0", 1), ("u" * 3000, 0), ("v", 0), ("w", 0)]
    assert sorted(common.labelled_sample(docs, labels, "toxic", F.lit(True), 5, most=4000)) == [("t0", 1), ("v", 0), ("w", 0)]
    assert len(common.sample(docs, F.lit(True), 5)) <= 5 and len(common.sample(docs, F.lit(True), 10_000)) == 703
    assert sorted(common.sample(docs, F.lit(True), 10_000, most=32)) == sorted(common.sample(docs, F.lit(True), 10_000, most=32)) != []
    first = langid.sample(docs, F.lit(True), 2)
    assert first == langid.sample(docs.repartition(7), F.lit(True), 2) and len(first) <= 4 and all(t == "t0" for t, _ in first if t[0] == "t")


def test_a_shared_folder_is_asked_for(spark):
    assert common.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master))
    assert common.shared_dir(session("local[4]"))
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            common.shared_dir(session(master))


def test_quality_learns_from_documents_without_labels(spark):
    bad = lambda i: " ".join(w + "&&&" for w in prose(i).split())
    docs = documents(spark, [(i, bad(i) if i >= 240 else prose(i)) for i in range(400)])
    positives = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id bigint, quality int")
    model = q.quality_model(docs, positives)
    score = lambda texts: [float(x) for x in model.score([quality.features(t) for t in texts])]
    fine = score([prose(2000 + i) for i in range(40)])
    assert sum(x < 0.5 for x in score([bad(1000 + i) for i in range(40)])) >= 34 and sum(x >= 0.5 for x in fine) >= 30
    train = common.crc_bucket(F.col("doc_id"), 4) != 2
    texts = common.sample(docs, train, 100)
    ids = {t: i for i, t in ((r.doc_id, r.text) for r in docs.collect())}
    assert len(texts) == 100 and all(zlib.crc32(str(ids[t]).encode()) % 4 != 2 for t in texts)
    assert max(ids[t] for t in texts) > 350 and 20 < sum(ids[t] >= 240 for t in texts) < 60
    assert len(common.sample(documents(spark, AWKWARD), F.lit(True), 100)) == 8  # the repeated row counts once


def plain_spans(rows):
    """The sentences to drop of each (id, text), by looking at every run."""
    where = {}
    cut = {}
    for k, t in rows:
        cut[k, t] = [(t or "")[a:b] for a, b in spans.sentences(t or "")]
        words = [c.lower().split() for c in cut[k, t]]
        a, b = spans.runs(list(map(len, words)))
        for x, y in zip(a.tolist(), b.tolist()):
            where.setdefault("\n".join(" ".join(w) for w in words[x:y]), set()).add((k, t, x, y))
    gone = {}
    for places in where.values():
        for k, t, x, y in sorted(places, key=lambda p: (p[0], p[2]))[1:]:
            gone.setdefault((k, t), set()).update(range(x, y))
    return cut, gone


def test_common_passages_are_dealt_out_and_all_found(spark, monkeypatch):
    monkeypatch.setattr(spans, "OFTEN", 3)
    passage = prose(51, 60)
    rows = [(i, prose(100 + i, 30) + " " + passage + " " + prose(500 + i, 30)) for i in range(150)]
    docs = documents(spark, rows)
    assert spans.common_hashes(docs, "doc_id", "text").count() > 0
    got = {r.doc_id: r for r in spans.dedup(docs).collect()}
    cut, gone = plain_spans(rows)
    assert all(got[k].n_removed == len(gone.get((k, t), ())) for k, t in rows) and got[0].n_removed == 0 and min(got[i].words_removed for i in range(1, 150)) >= 40


def plain_cut(text):
    """The sentences of a text in Latin letters, word by word: long ones are cut before the least word of every eight."""
    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
        for sentence in re.split(r"(?<=[.!?])(?=\s)", line):
            words = sentence.lower().split()
            rank = [(len(w) < 4, xxhash.xxh32_intdigest(w) >> 2) for w in words]
            places = {0} if words else set()
            if len(words) > 16:
                for a in range(len(words) - 7):
                    least = min(range(a, a + 8), key=lambda i: (rank[i], i))  # noqa: B023
                    if least and words[least] != words[least - 1]:
                        places.add(least)
                for a, b in zip(sorted(places), [*sorted(places)[1:], len(words)]):
                    places |= set(range(a, b, 20)) if b - a > 16 else set()
            places = sorted(places)
            out += (words[a:b] for a, b in zip(places, [*places[1:], len(words)]))
    return out


def test_every_text_has_its_sentences_counted_and_cut_as_by_a_plain_cutter(spark):
    rng = random.Random(12)
    rows = [(i, prose(300 + i, rng.randrange(1, 200))) for i in range(30)]
    rows += [(100 + i, " ".join(rng.choices(VOCABULARY[:40] + ["a", "to", "a"], k=rng.randrange(1, 120)))) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "a " * 90), (203, "One. Two!\n\n Three? four"), (204, rows[3][1] + "\n" + rows[4][1])]
    got = {r.doc_id: r for r in spans.dedup(documents(spark, rows)).collect()}
    for k, t in rows:
        assert spans.pieces(t or "") == plain_cut(t) and got[k].n_sentences == len(plain_cut(t))


@pytest.mark.parametrize("key", [7, None])
def test_texts_of_one_id_keep_their_own_spans(spark, monkeypatch, key):
    """Different texts of one id, or of none, share a passage; each loses its own sentences, and one of them none."""
    passage = prose(52, 60)
    texts = [prose(700 + i, 10 + 3 * i) + " " + passage + " " + prose(800 + i, 12) for i in range(20)]
    rows = [(key, t) for t in texts] + [(key, texts[0])]
    got = spans.dedup(documents(spark, rows)).collect()
    assert len(got) == 21 and sum(r.n_removed == 0 for r in got) in (1, 2)
    assert sorted(r.n_sentences for r in got) == sorted(len(plain_cut(t)) for _, t in rows)
    middle = passage.split(". ")[3]
    for r in got:
        mine = [t for t in texts if r.text == t] if r.n_removed == 0 else [t for t in texts if middle not in r.text and t.startswith(r.text[:30])]
        assert len(mine) == 1 and r.n_sentences == len(plain_cut(mine[0]))


def test_sentence_spans(spark, awkward, empty):
    passage = prose(50, 55)
    rows = [(i, prose(100 + i, 40) + " " + passage + " " + prose(200 + i, 30)) for i in range(12)]
    rows += [(20, passage), (21, prose(3) + "\n" + prose(3)), (22, ""), (23, "Short. Short. Short.")]
    got = {r.doc_id: r for r in spans.dedup(documents(spark, rows)).collect()}
    cut, gone = plain_spans(rows)
    for k, t in rows:
        want = "".join(c for i, c in enumerate(cut[k, t]) if i not in gone.get((k, t), ()))
        assert got[k].n_removed == len(gone.get((k, t), ()))
        assert got[k].text == (want.strip() if gone.get((k, t)) else t)
    assert got[0].n_removed == 0 and all(passage.split(". ")[2] not in got[i].text for i in range(1, 12)) and got[20].text == ""
    out = check(spans.dedup(awkward))
    assert [r.text for r in out if r.doc_id == 1] == [None] and all(r.n_removed == 0 for r in out if r.doc_id in (2, 3, 4, 5, 7))
    check(spans.dedup(empty), 0)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_pii(spark, awkward, empty):
    rng = random.Random(8)
    texts = [
        "mail a.b+c@x-y.co.uk. or a@b or a@b.c_d@e.f now", "🙂 1.2.3.4.5.6.7.8 and 300.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111, 4111111111111112 0-0", "call +1 (988) 555-2485 or +12 or +1234567 or +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
        "a" * 3000 + "@" + "b" * 10, "1" * 5000, "." * 50 + "@x.y", "phone: 555-123-4567 ssn 123-45-6789 version 555-123-4567", "x@y.z" * 20, "+" * 20, "1 " * 300,
    ]
    texts += ["".join(rng.choices("019 .-@+()ab_é🙂", k=rng.randrange(60))) for _ in range(200)]
    rows = list(enumerate(texts))
    got = pii.detect(documents(spark, rows), F.col("text"), F.col("doc_id"))
    got = {r.doc_id: r for r in got.select("doc_id", pii.rendered(F.col("base")).alias("base"), F.size("added").alias("n"), pii.masked(F.lit("x"), F.filter("base", lambda x: F.lit(False))).alias("m")).collect()}
    for k, t in rows:
        assert got[k].base == ",".join(f"{a}:{b}:{c}" for a, b, c in plain_base(t)), t[:80]
    out = check(pii.detect(awkward, F.col("text"), F.col("doc_id")))
    assert all(not r.base and not r.added for r in out)
    check(pii.detect(empty, F.col("text"), F.col("doc_id")), 0)


def test_looser_personal_data_is_decided_by_the_votes(spark):
    rng = random.Random(21)
    digit = lambda k: "".join(rng.choices("0123456789", k=k))
    mail = lambda: f"{rng.choice(VOCABULARY)}.{digit(2)}@{rng.choice(VOCABULARY)}.com"
    national = lambda: f"{rng.randrange(201, 989)}-{rng.randrange(201, 989)}-{digit(4)}"
    rows, want = [], {}
    for i in range(300):
        kind, text = i % 5, prose(i, 12)
        add = (f"mail {mail()}", f"phone: {national()}", f"order {national()}", f"ip {digit(2).strip('0') or 1}.2.3.4", f"number 9{digit(15)}")[kind]
        rows.append((i, f"{text} {add} {text}"))
        want[i] = kind
    found = pii.detect(documents(spark, rows), F.col("text"), F.col("doc_id"))
    added = {r.doc_id: [pii.KINDS[x.kind] for x in r.added] for r in found.collect()}
    assert all(added[i] == ["national_phone"] for i in want if want[i] == 1)
    assert not any(added[i] for i in want if want[i] in (0, 2, 3, 4))
    spelled = pii.candidates(documents(spark, [(1, "write jane.doe (at) mail (dot) org or a[at]b.com"), (2, "4111 1111 1111 1112 x"), (3, "1.2.3.4 " * 600)]), F.col("text"), F.col("doc_id"))
    got = {r.doc_id: r for r in spelled.collect()}
    assert [(pii.KINDS[x.kind], x.start, x.end) for x in got[1].loose] == [("spelled_email", 6, 34), ("spelled_email", 38, 48)]
    assert [(pii.KINDS[x.kind], x.start, x.end) for x in got[2].loose] == [("loose_card", 0, 19)]
    assert [(x.start, x.end) for x in got[3].base] == [(8 * i, 8 * i + 7) for i in range(600)]


def test_added_spans_are_those_that_plain_loops_accept(spark):
    rng = random.Random(32)
    number = lambda k: "".join(rng.choices("0123456789", k=k))
    forms = [lambda: f"phone: {number(3)}-{number(3)}-{number(4)}", lambda: f"order no. {number(3)}-{number(3)}-{number(4)}", lambda: f"ssn {number(3)}-{number(2)}-{number(4)}", lambda: f"card {number(16)}", lambda: f"IBAN DE{number(2)} {number(4)} {number(4)} {number(4)}", lambda: f"write j{number(2)} (at) mail (dot) org", lambda: f"x{number(3)}-{number(2)}-{number(4)}y", lambda: f"jane{number(1)}@mail.org", lambda: f"{number(2)}.{number(3)}.1.{number(1)}"]
    docs = spark.createDataFrame([(i, " so it is ".join(rng.choice(forms)() for _ in range(rng.randrange(5)))) for i in range(240)], "doc_id long, text string")
    key = lambda x: (x.kind, tuple(x.votes), tuple(x.features))
    loose, every = {}, []
    for r in pii.candidates(docs, F.col("text"), F.col("doc_id")).collect():
        loose[r.doc_id] = [(key(x), x.start, x.end) for x in r.loose]
        every += [key(x) for x in (*r.base, *r.loose)]
    score = plain_weak_supervision(every)
    got = {r.doc_id: [(key(x), x.start, x.end) for x in r.added] for r in pii.detect(docs, F.col("text"), F.col("doc_id")).collect()}
    assert got == {i: [x for x in spans if score[x[0]] >= 0] for i, spans in loose.items()}
    assert 0 < sum(map(len, got.values())) < sum(map(len, loose.values()))


def test_pii_mask(spark):
    docs = documents(spark, [(1, "🙂 write a@b.cd or 1.2.3.4."), (2, "none")])
    found = pii.detect(docs, F.col("text"), F.col("doc_id"), F.col("text").alias("t"))
    assert {r[0] for r in found.select(pii.masked(F.col("t"), F.col("base"))).collect()} == {"🙂 write [PII] or [PII].", "none"}


def sets_of(rows, n=5):
    out = {}
    for k, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        out[k] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    return out


def plain_classes(rows, threshold=0.8):
    sets = sets_of(rows)
    root = {k: k for k in sets}
    links = dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and len(x & y) >= threshold * len(x | y)):
                links[a] += 1
                links[b] += 1
                p, r = find(a), find(b)
                root[max(p, r)] = min(p, r)
    return {k: (find(k), links[k]) for k in keys}


def changed(text, seed, k):
    words = text.split()
    rng = random.Random(seed)
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


def test_near_duplicates_across_cells(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 6)
    base = prose(60, 150)
    rows = [(i, changed(base, i, i % 5)) for i in range(30)] + [(100 + i, base) for i in range(5)]
    rows += [(200 + i, prose(300 + i)) for i in range(20)] + [(300, ""), (301, None), (302, "?!"), (303, "a b"), (304, "A, b")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.join(documents(spark, rows)).collect()}
    assert got == plain_classes(rows)
    out = check(neardup.join(awkward))
    assert {r.n_links for r in out if r.doc_id in (1, 2, 3, 9)} == {4} and {r.n_links for r in out if r.doc_id in (5, 6)} == {2}
    check(neardup.join(empty), 0)


@pytest.mark.parametrize("copies", [2, 12])
def test_forest_at_both_levels(spark, copies):
    """Copies that are alike keep the prefixes deep, those near the threshold shorten them; either way the classes are those of brute force."""
    rows = [(1000 * i + k, changed(prose(400 + i, 200), 17 * i + k, k % copies)) for i in range(12) for k in range(5)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.join(documents(spark, rows)).collect()}
    assert got == plain_classes(rows)


def rare_link(pairs=80):
    """Many pairs of close copies, and as ids 1000 and 1001 two texts just above the threshold that share a prefix of 4 minima and none of 6."""
    hashes, factors = neardup.Hashes(), neardup.multipliers(neardup.TREES, neardup.DEEPEST)
    for seed in range(50_000):
        words = prose(seed, 50).split()
        texts = [" ".join(words), " ".join([*words[:20], "zzz", *words[21:]])]
        a, b = (neardup.labels(neardup.shingles(t, 5, hashes), factors, neardup.TREES, 4) for t in texts)
        if (a == b)[:, 0].any() and not (a == b)[:, 2].any():
            break
    rows = [(2 * i + k, changed(prose(5000 + i, 200), i, k)) for i in range(pairs) for k in range(2)]
    return rows + [(1000 + k, t) for k, t in enumerate(texts)]


def test_no_link_is_lost_among_closer_copies(spark):
    """However alike most matches are, texts at the threshold are linked too."""
    rows = rare_link()
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.join(documents(spark, rows)).collect()}
    assert got[1000] == got[1001] == (1000, 1) and got == plain_classes(rows)


@pytest.mark.parametrize("key", [7, None])
def test_near_copies_under_one_id_are_verified_once_each(spark, key):
    """Thousands of near copies of one id, or of none, and rows that repeat: the same links as with ids of their own, in about the same time."""
    base = prose(90, 150)
    texts = [changed(base, i, 1) for i in range(1500)] + [prose(91, 30)]
    own = sorted(r.n_links for r in neardup.join(documents(spark, list(enumerate(texts)))).collect())
    began = time.time()
    got = neardup.join(documents(spark, [(key, t) for t in texts])).collect()
    assert sorted(r.n_links for r in got) == own and {r.class_id for r in got} == {key} and time.time() - began < 60
    again = neardup.join(documents(spark, [(key, t) for t in texts[:40]] + [(key, texts[0])] * 200)).collect()
    assert len(again) == 240 and max(r.n_links for r in again) >= 200 and {r.class_id for r in again} == {key}


def test_pipeline_keeps_one_of_distant_copies_among_closer_ones(spark):
    rows = rare_link()
    docs = documents(spark, rows).select(*corpus_pipeline.COLUMNS)
    kept = sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect())
    assert kept == sorted({root for root, _ in plain_classes(rows).values()}) and 1000 in kept and 1001 not in kept


def test_near_duplicates_of_repeated_ids_keep_one_document(spark):
    a, b = prose(80, 80), prose(81, 80)
    docs = documents(spark, [(3, b), (5, a), (5, b), (3, changed(b, 1, 1)), (3, b), (7, a), (None, prose(82)), (None, prose(82)), (8, None), (9, "")])
    docs = docs.select(*corpus_pipeline.COLUMNS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()]
    assert len(kept) == 4 and {(5, a), (None, prose(82)), (8, None)} < set(kept) and any(k == 3 and t in (b, changed(b, 1, 1)) for k, t in kept)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(500, 501 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, r = find(a), find(b)
        root[max(p, r)] = min(p, r)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def word_list(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(text, items):
    words, hit, found = word_list(text), set(), set()
    for item, body in items:
        w = word_list(body)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("broadcast_rows", [300_000, 0])
def test_contamination(spark, awkward, empty, broadcast_rows):
    items = [(1, prose(70, 40)), (2, prose(71, 12)), (10, "Short item É"), (4, None), (5, ""), (6, prose(70, 40)), (7, "solo"), (8, prose(72, 9))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    a = items[0][1].split()
    rows = [(1, prose(1) + " " + items[0][1].upper() + " " + prose(2)), (2, " ".join(a[5:15])), (3, " ".join(a[5:14])), (4, "x short, item É y Short item é"), (5, items[1][1] * 3), (6, None), (7, ""), (8, "solo solo"), (9, prose(9) + items[7][1])]
    rows += [(5, prose(5)), (2, " ".join(a[5:15]))]
    run = lambda d, b: decontam.contamination(d, b, broadcast_rows=broadcast_rows)
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in run(documents(spark, rows), bench).collect())
    assert got == sorted((k, *plain_hits(t, items)) for k, t in rows)
    check(run(awkward, bench))
    check(run(empty, bench), 0)
    assert all(r.n_hit == 0 for r in check(run(awkward, bench.limit(0))))


@pytest.mark.parametrize("broadcast_rows", [300_000, 0])
def test_contamination_by_items_without_an_id(spark, broadcast_rows):
    bench = spark.createDataFrame([(None, prose(70, 40)), (None, prose(73, 15)), (1, prose(70, 12)), (None, "solo")], "item_id bigint, text string")
    a = prose(70, 40).split()
    rows = [(1, prose(1)), (2, " ".join(a[20:35])), (3, " ".join(a[:30])), (4, prose(73, 15) + " solo"), (5, None), (6, "solo")]
    found = decontam.contamination(documents(spark, rows), bench, broadcast_rows=broadcast_rows).collect()
    got = sorted((r.doc_id, r.n_hit, list(r["items"])) for r in found)
    assert got == [(1, 0, []), (2, 15, [None]), (3, 30, ["1", None]), (4, 16, [None]), (5, 0, []), (6, 1, [None])]


def test_secrets_and_pieces(awkward, empty):
    for docs, n in ((awkward, len(AWKWARD)), (empty, 0)):
        found = check(secrets.scan(docs, F.col("text"), F.col("doc_id"), vocabulary_path=q.VOCABULARY, mask="*"), n)
        assert all(r.spans == "" for r in found)
        coded = check(pieces.encode(docs, F.col("text"), F.col("doc_id"), model_path=q.PIECES, keep=("ids", "decoded")), n)
        for r in coded:
            if r.doc_id == 1:
                assert r.ids is None and r.parity is None
            elif r.n_tokens is not None:
                assert r.parity and r.round_trip and len(r.ids) == r.n_tokens


def test_pieces_are_decoded(spark):
    rows = [r for r in AWKWARD if r[0] is not None]
    coded = pieces.encode(documents(spark, rows), F.col("text"), F.col("doc_id"), model_path=q.PIECES)
    got = pieces.decode(coded, F.col("ids"), F.col("doc_id"), model_path=q.PIECES).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(rows, key=repr)
    odd = spark.createDataFrame([(1, [32_000]), (2, [-1]), (3, []), (4, [1, 2])], "doc_id bigint, ids array<int>")
    assert [r.text for r in pieces.decode(odd, F.col("ids"), F.col("doc_id"), model_path=q.PIECES).orderBy("doc_id").collect()] == [None, None, "", ""]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def plain_secrets(text):
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", m) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 8]
    found += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    return sorted(((k, *m.span()) for k, m in found), key=lambda x: (x[1], order.index(x[0])))


COLUMNS = {
    "op1_telephony_audio": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op2_toxicity_grammar": ["doc_id", "held_out", "score", "predicted"],
    "op3_language_spans": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_sentence_spans": ["doc_id"],
    "op5_pii_weak_supervision": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_ngram_jaccard": ["doc_id", "class_id", "n_links"],
    "op7_winnowing": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8_sentencepiece": ["doc_id", "n_tokens"],
    "op9_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10_quality_pu": ["doc_id", "held_out", "score", "predicted"],
}


def test_queries_keep_their_contracts(spark):
    """Columns, folds, counts and digests of every query over a whole table, against plain computations."""
    import sentencepiece

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    theirs = sentencepiece.SentencePieceProcessor(model_file=q.PIECES)
    classes = plain_classes(list(texts.items()))
    held = {"op2_toxicity_grammar": (5, 0, 0.5), "op3_language_spans": (5, 0, None), "op10_quality_pu": (4, 2, 0.7)}
    for name, f in q.QUERIES.items():
        frame = f(spark, d)
        assert frame.columns[: len(COLUMNS[name])] == COLUMNS[name], name
        rows = frame.collect()
        assert sorted(r.doc_id for r in rows) == sorted(texts), name
        for r in rows:
            text = texts[r.doc_id]
            if name in held:
                m, k, least = held[name]
                assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == k) and 0 <= r.score <= 1
                assert least is None or r.predicted == int(r.score >= least)
            elif name.startswith("op1_"):
                raw = text.encode()
                payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
                assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
                codec = telephony.CODECS[zlib.crc32(payload) % 3]
                assert r.media_sha256 == sha(telephony.wave(payload, codec)) and r.feature.split(":")[0] == codec and len(r.pcm) == 2 * int(r.feature.split(":")[1])
            elif name.startswith("op5_"):
                base = plain_base(text)
                assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in BASE]
                listed = [f"{k}:{a}:{b}" for k, a, b in base]
                assert r.base_sha256 == sha(",".join(listed)) and set(listed) <= set(r.spans.split(","))
            elif name.startswith("op6_"):
                assert (r.class_id, r.n_links) == classes[r.doc_id]
            elif name.startswith("op7_"):
                n_words, n_hit, found = plain_hits(text, items)
                assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n_words, n_hit, len(found), sha(",".join(found)), n_hit > 0)
            elif name.startswith("op8_"):
                ids = theirs.encode(text)
                assert r.n_tokens == len(ids) and r.ids_sha256 == sha(b"".join(i.to_bytes(4, "little") for i in ids)) and r.parity and r.round_trip == (theirs.decode(ids) == text)
            elif name.startswith("op9_"):
                base = plain_secrets(text)
                assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, *_ in base) for x in ("assign", "access", "hex")]
                listed = [f"{k}:{a}:{b}" for k, a, b in base]
                assert r.base_sha256 == sha(",".join(listed)) and set(filter(None, listed)) <= set(r.spans.split(","))


def test_fitted_queries_over_empty_tables(spark, tmp_path):
    """Without documents, without labels, and with labels of extra columns and clashing names."""
    d = "/root/testdata/sf0.001"
    few = spark.read.parquet(f"{d}/documents.parquet").limit(30)
    labels = spark.read.parquet(f"{d}/labels.parquet").withColumns({"text": F.lit("x"), "_id": F.lit("y"), "_h": F.lit(1), "_y": F.lit(2)})
    for k, (docs, marks) in enumerate([(few.limit(0), labels), (few, labels.limit(0)), (few.limit(0), labels.limit(0)), (few, labels)]):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        for name in ("op2_toxicity_grammar", "op3_language_spans", "op10_quality_pu"):
            rows = q.QUERIES[name](spark, f"{tmp_path}/{k}").collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows), (k, name)


def test_pipeline(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, d))
        kept.append({r.doc_id: r for r in docs.collect()})
        if name != "encoding":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert set(before) >= set(kept[0]) >= set(kept[1]) >= set(kept[2]) == set(kept[3]) == set(kept[4])
    classes = plain_classes([(k, r.text) for k, r in kept[0].items()])
    assert set(kept[1]) == {c for c, _ in classes.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert set(kept[2]) == {k for k, r in kept[1].items() if not plain_hits(r.text, items)[1]}
    for k, r in kept[3].items():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text) and (r.text == kept[2][k].text) == (corpus_pipeline.MASK not in r.text)
    rows = documents(spark, AWKWARD)
    for _, stage in corpus_pipeline.STAGES:
        rows = common.stored(stage(spark, rows, d))
    rows = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        rows = common.stored(stage(spark, rows, d))
    assert rows.count() == 0
