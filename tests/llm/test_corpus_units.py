"""The corpus operators' parts that need no session."""

from __future__ import annotations

import builtins
import dis
import math
import random
import struct
from types import CodeType, FunctionType

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import langid, neardup, pieces, pii, quality, secrets, spans, telephony, toxicity

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_mulaw_and_alaw_tables():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def plain_adpcm(block):
    sample, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = telephony.STEPS[index]
            d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - d if code & 8 else sample + d))
            index = max(0, min(88, index + telephony.INDEX_CHANGES[code & 7]))
            out.append(sample)
    return out


def test_adpcm_against_a_plain_decoder():
    data = np.random.default_rng(1).integers(0, 256, (7, 192), dtype=np.uint8)
    assert telephony.decode_adpcm(data).tolist() == [plain_adpcm(bytes(b)) for b in data]


@given(st.binary(max_size=500), st.sampled_from(telephony.CODECS))
@settings(max_examples=60, deadline=None)
def test_container_round_trip(data, codec):
    data = telephony.padded(data)
    assert len(data) % 192 == 0 and data
    got = telephony.unwave(telephony.wave(data, codec))
    assert got[0] == codec and got[2] == data
    assert telephony.unwave(telephony.wave(data, codec)[:-5]) is None


def test_damaged_containers():
    for bad in (b"", b"RIFF", b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0WAVEdata\x05\0\0\0abcde", telephony.wave(b"x" * 191, "adpcm")):
        assert telephony.unwave(bad) is None


def test_upsampling_keeps_samples_and_ends():
    x = np.array([0, 1000, -1000, 500, 7], dtype=np.int16)
    both = telephony.upsample(np.concatenate([x, x[:2]]), np.array([5, 0, 2]))
    assert both[0::2].tolist() == [*x, *x[:2]]
    assert both[:10].tolist() == telephony.upsample(x, np.array([5])).tolist()
    flat = telephony.upsample(np.full(40, 1234, dtype=np.int16), np.array([40]))
    assert set(flat[10:-10].tolist()) == {1234}


def test_toxic_grammar_scores_clauses():
    lexicon = toxicity.Lexicon({"moron": 3.0}, {"réeux": 2.0})
    scan = toxicity.Scanner(lexicon)
    events = lambda t: [toxicity.EVENTS[int(np.argmax(w))] for _, _, w in scan.clauses(t)]
    assert events("What a moron. Fine day.") == ["insult"]
    assert events("you utter moron") == ["directed"]
    assert events("you are not a moron!") == ["denied"]
    assert events("he said: moron") == ["quoted"] and events('the word "moron" is rude') == ["quoted"]
    assert events("i will find you and kill them") == ["threat"]
    assert events("kill the lights") == [] and events("") == [] and events(None) == []
    assert events("Réeuxpa, réeuxon, ok. réeux") == ["insult"]
    start, end, _ = scan.clauses("Fine. A moron here. Bye")[0]
    assert "Fine. A moron here. Bye"[start:end].strip() == "A moron here"


def clauses_of(text, lexicon=None):
    scan = toxicity.Scanner(lexicon or toxicity.Lexicon({"moron": 3.0, "idiot": 2.0}, {}))
    return [{e: x for e, x in zip(toxicity.EVENTS, w) if x} for _, _, w in scan.clauses(text)]


@pytest.mark.parametrize("text", ["I will kill you", "we will hurt them", "go kill yourself", "I will murder you", "I am killing you", "He killed you", "Ich töte dich", "je te tuerai", "Ich werde dich töten", "you kill them", "voy a golpear os", "They're gonna shoot him"])
def test_threats(text):
    assert clauses_of(text) == [{"threat": 1.0}]


@pytest.mark.parametrize("text", ["burn calories and you feel fine", "We beat them 3-1 yesterday", "kill the process, you can restart it", "kill. you", "you kill the lights", "mate you", "will you burn", "tu mates", "I shoot him an e-mail"])
def test_no_threats(text):
    assert clauses_of(text) == []


def test_threats_with_what_stands_around_them():
    assert clauses_of("I will not kill you") == [{"denied": 1.0}] and clauses_of('"kill you"') == [{"quoted": 1.0}]
    assert clauses_of("kill you moron") == [{"directed": 3.0, "threat": 1.0}]
    assert clauses_of("moron, that is what you are") == [{"insult": 3.0, "directed": 1.0}] and clauses_of("moron one two three four you") == [{"insult": 3.0}]
    assert clauses_of("he told us: I will kill you, moron") == [{"quoted": 4.0}]


def test_quotes_stay_open_over_sentence_marks_and_apostrophes_are_one():
    assert clauses_of('He said: "You are a moron. You are an idiot."') == [{"quoted": 3.0}, {"quoted": 2.0}]
    assert clauses_of('He said: "You are a moron. Fine." You are an idiot.') == [{"quoted": 3.0}, {"directed": 2.0}]
    assert clauses_of('an open " quote\nYou moron') == [{"directed": 3.0}]
    assert clauses_of("You aren’t a moron") == clauses_of("You aren't a moron") == [{"denied": 3.0}]


def test_threats_are_learned_and_without_toxic_texts_nothing_is_toxic():
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefg", k=6)) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=30)) + (" i zorgle you." if i % 4 == 0 else " i greet you.") for i in range(200)]
    lexicon = toxicity.learn_lexicon([t for t in texts] + ["they zorgle fast " + t for t in texts[1::2]], [int(i % 4 == 0) for i in range(200)] + [0] * 100)
    assert "zorgle" in lexicon.threats and "greet" not in lexicon.threats and clauses_of("we zorgle them", lexicon)[0].keys() == {"threat"} and clauses_of("we zorgle", lexicon) == []
    for texts, labels in (([], []), (["fine", "well"], [0, 0])):
        none = toxicity.fit(texts, labels)
        assert max(none.score(np.array([toxicity.Scanner(none.lexicon).features(t) for t in ("", "fine", "I will kill you")]))) < 0.01


def plain_events(tags):
    """The events of a text's tags, by looking around each."""
    out, quoted, said, start, wait, met = [], False, False, 0, None, set()
    for i, tag in enumerate(tags):
        near = lambda *t: any(x in t for x in tags[max(start, i - toxicity.SCOPE) : i])  # noqa: E731, B023
        verb = lambda k: k >= start and (tags[k] == "THREAT" or tags[k] == "HARM" and "WILL" in tags[max(start, k - toxicity.SCOPE) : k])  # noqa: E731, B023
        if tag == "END":
            said, start, wait = False, i + 1, None
        quoted ^= tag == "QUOTE"
        said |= tag == "REPORT"
        attack = verb(i) and i > start and tags[i - 1] == "CLITIC" and i - 1 not in met or tag in ("OBJECT", "CLITIC") and i > start and verb(i - 1) and i - 1 not in met
        event = None
        if attack:
            met.add(i)
        if attack or tag == "INSULT":
            if said or quoted:
                event = "quoted"
            elif near("NEGATION"):
                event = "denied"
            elif attack:
                event = "threat"
            elif near("TARGET", "OBJECT", "CLITIC") or any(k in met for k in range(max(start, i - toxicity.SCOPE), i)):
                event, wait = "directed", None
            else:
                event, wait = "insult", i
        elif tag in ("TARGET", "OBJECT", "CLITIC") and wait is not None and i - wait <= toxicity.SCOPE:
            event, wait = "directed", None
        out.append(event)
    return out


@given(st.lists(st.sampled_from(toxicity.TAGS), max_size=14))
@settings(max_examples=300, deadline=None)
def test_the_composed_machine_against_plain_rules(tags):
    following, emitted = toxicity.grammar()
    state, got = 0, []
    for tag in tags:
        k = toxicity.TAGS.index(tag)
        got.append(toxicity.EVENTS[emitted[state][k]] if emitted[state][k] >= 0 else None)
        state = following[state][k]
    assert got == plain_events(tags)


def test_reported_and_denied_insults_score_less():
    rng = random.Random(17)
    words = ["".join(rng.choices("abcdefg", k=6)) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=30)) + (" you twonk." if i % 5 == 0 else ".") for i in range(400)]
    model = toxicity.fit(texts, [int(i % 5 == 0) for i in range(400)])
    scan = toxicity.Scanner(model.lexicon)
    plain, denied, said, quoted = model.score(np.array([scan.features(t) for t in ("you twonk", "you are not a twonk", "he said you are a twonk", 'it was "you twonk" again')]))
    assert plain > 0.5 > max(denied, said, quoted)


def test_toxicity_learns():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefg", k=6)) for _ in range(200)]
    texts, labels = [], []
    for i in range(400):
        y = int(i % 5 == 0)
        texts.append(" ".join(rng.choices(words, k=30)) + (" " + rng.choice(["gormless", "twonk"]) if y else "") + ".")
        labels.append(y)
    model = toxicity.fit(texts, labels)
    scan = toxicity.Scanner(model.lexicon)
    p = model.score(np.array([scan.features(t) for t in [*texts, "", "what a twonk"]]))
    assert ((p[:-2] >= 0.5) == np.array(labels)).mean() > 0.98 and p[-2] < 0.5 < p[-1]
    empty = toxicity.fit([], [])
    assert 0 <= empty.score(np.array([toxicity.Scanner(empty.lexicon).features("x")]))[0] <= 1


def viterbi_by_brute_force(scores, penalty):
    n, k = scores.shape
    best, arg = -math.inf, None
    for code in range(k**n):
        path = [(code // k**i) % k for i in range(n)]
        total = sum(scores[i, s] for i, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        if total > best:
            best, arg = total, path
    return best, arg


def test_viterbi():
    rng = np.random.default_rng(2)
    sizes = np.array([4, 0, 6, 1])
    scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    path = langid.viterbi(scores, first, sizes, 0.7)
    for f, n in zip(first, sizes):
        if n:
            assert path[f : f + n].tolist() == viterbi_by_brute_force(scores[f : f + n], 0.7)[1]


def test_language_spans():
    en, de = "the cat and the dog were there with this ", "der hund und die katze waren nicht mit uns "
    ru = "кот и собака были там "
    model = langid.fit([en * 20, de * 20, ru * 20], ["en", "de", "ru"])
    text = en * 3 + "42, " + de * 3 + ru
    got = langid.label([text, "", None, "12 !", "Кот"], model, 8.0)
    assert [s["lang"] for s in got["spans"][0]] == ["en", "de", "ru"]
    assert all(text[s["start"] : s["end"]] == text[s["start"] : s["end"]].strip() for s in got["spans"][0])
    assert got["lang_pred"] == [got["lang_pred"][0], "und", "und", "und", "ru"] and got["score"][1] == 0
    assert langid.label(["abc"], langid.fit([], []), 8.0)["lang_pred"] == ["und"]


def test_marks_without_a_letter_are_no_words():
    model = langid.fit(["the cat sat " * 20, "der hund bellt " * 20], ["en", "de"])
    got = langid.label(["\u0301\u0301 \u0302", "12\u0301", "\u0301the cat", "the\u0301 cat"], model, 8.0)
    assert got["lang_pred"] == ["und", "und", "en", "en"] and got["score"][:2] == [0, 0]
    assert [(s[0]["start"], s[0]["end"]) for s in got["spans"][2:]] == [(1, 8), (0, 8)]


def plain_runs(n):
    out = set()
    for a in range(len(n)):
        for b in range(a + spans.SEVERAL, len(n) + 1):
            if sum(n[a:b]) >= spans.LEAST:
                out.add((a, b))
                break
    for b in range(spans.SEVERAL, len(n) + 1):
        for a in range(b - spans.SEVERAL, -1, -1):
            if sum(n[a:b]) >= spans.LEAST:
                out.add((a, b))
                break
    return sorted(out)


@given(st.lists(st.integers(1, 30), max_size=30))
@settings(max_examples=100, deadline=None)
def test_runs(sizes):
    a, b = spans.runs(sizes)
    assert list(zip(a.tolist(), b.tolist())) == plain_runs(sizes)
    assert all(y - x < 1 << spans.RUN_BITS for x, y in zip(a, b))


def test_run_hashes_agree_only_for_equal_runs():
    h = np.array([5, 6, 7, 5, 6, 7, 6, 5], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.array([0, 3, 0, 6, 1]), np.array([2, 5, 3, 8, 3])
    x = spans.run_hash(h, a, b, spans.Powers(spans.FACTORS[0]))
    assert x[0] == x[1] and len(set(x.tolist())) == 4


def test_sentences():
    cut = lambda t: [t[a:b] for a, b in spans.sentences(t)]
    assert cut("A b. C 4.0 d!\n\nE") == ["A b.", " C 4.0 d!", "E"] or cut("A b. C 4.0 d!\n\nE") == ["A b.", " C 4.0 d!", "\nE"]
    assert cut("") == [] and cut(" \n ") == [] and len(cut("w " * 95)) == 5
    assert spans.without(None, [])[-1] is None and spans.without("", [])[-1] == ""
    assert spans.without("One two. Three. Four.", [(1 << spans.RUN_BITS) | 1]) == (1, 1, "8:15", "One two. Four.")


def left_of(first, second):
    """What a text that follows another keeps of its words, by looking at every run."""
    runs_of = lambda p: [("\n".join(" ".join(w) for w in p[a:b]), a, b) for a, b in zip(*(x.tolist() for x in spans.runs(list(map(len, p)))))]
    seen = {key for key, _, _ in runs_of(spans.pieces(first))}
    mine = spans.pieces(second)
    gone = {i for key, a, b in runs_of(mine) if key in seen for i in range(a, b)}
    return [w for i, p in enumerate(mine) if i not in gone for w in p]


def test_a_passage_within_long_sentences_is_found_at_any_offset():
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n)]
    passage = words(70)
    first = " ".join([*words(33), *passage, *words(20)])
    for offset in range(45):
        around = words(offset), words(25)
        left = left_of(first, " ".join([*around[0], *passage, *around[1]]))
        assert len(left) - offset - 25 <= 35
        changed = [*passage[:10], "x", *passage[10:]]
        assert len(left_of(first, " ".join([*around[0], *changed, *around[1]]))) <= offset + 25 + 50
    assert [text.lower().split() for text in map(lambda p: first[p[0] : p[1]], spans.sentences(first))] == spans.pieces(first)
    assert max(map(len, spans.pieces(first))) <= spans.LONG


def test_any_fifty_shared_words_hold_a_run():
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(n)]
    for sizes in ((39, 3, 27), (29, 9, 3, 6, 26), (16,) * 6, (15,) * 6, (17,) * 6, (50, 52), (31, 31), (40, 40), (200,)):
        for _ in range(30):
            plain = words(sum(sizes))
            ends = set(np.cumsum(sizes).tolist())
            text = lambda ws, at: " ".join(w + "." * (at + i + 1 in ends) for i, w in enumerate(ws))
            start = rng.randrange(sum(sizes) - 49)
            shared = text(plain[start : start + 50], start)
            left = left_of(text(plain, 0), " ".join([*words(rng.randrange(30)), shared, *words(rng.randrange(30))]))
            assert len(set(left) & set(shared.split())) <= 30
    assert len(left_of("a b c. d e f.", "a b c. d e f.")) == 6


def test_spans_of_texts_without_spaces_and_of_letters_that_grow_in_lower_case():
    rng = random.Random(13)
    for a, b, mark in ((0x4E00, 0x9000, "。"), (0x3041, 0x3090, "！"), (0x0E01, 0x0E2E, " ")):
        script = lambda n: "".join(chr(rng.randrange(a, b)) for _ in range(n))  # noqa: E731, B023
        passage = script(30) + mark + script(30) + mark + script(40)
        for around in (script(7), script(22)):
            left = left_of(script(13) + passage + script(9), around + passage + script(9))
            assert len(left) <= len(around) + 9 + 34
    assert [("一二。三四！ab." + "c d")[x:y] for x, y in spans.sentences("一二。三四！ab." + "c d")] == ["一二。", "三四！", "ab.c d"]
    words = ["".join(rng.choices("abcdefghij", k=6)).capitalize() for _ in range(60)]
    passage = " ".join(words[:30]) + ". " + " ".join(words[30:]) + "."
    assert len(left_of(passage, "\u0130stanbul. " + passage)) <= 1
    text = "\u0130\u0130 x. " + passage
    assert "".join(text[x:y] for x, y in spans.sentences(text)) == text
    assert spans.without(text, [1])[3] == passage


def test_depth_is_shortened_until_the_target():
    assert neardup.depth_for(0.8, 0.99999) == 4 and neardup.depth_for(0.8, 0.9) == 6 and neardup.depth_for(0.1, 0.99999) == 1
    assert neardup.depth_of([0.99] * 50, 4, 0.99999, 24) == 6 and neardup.depth_of([0.8] * 50, 4, 0.99999, 24) == 4 == neardup.depth_of([], 4, 0.99999, 24)
    assert neardup.depth_of([0.99] * 20 + [0.8], 4, 0.99999, 24) == 5
    rng = random.Random(16)
    grams = np.array(sorted(rng.getrandbits(64) for _ in range(90)), dtype=np.uint64)
    factors = neardup.multipliers(24, neardup.DEEPEST)
    found = neardup.labels(grams, factors, 24, 4)
    other = neardup.labels(grams[:70], factors, 24, 4)
    same = found == other
    # equal deeper nodes have equal shallower ones
    assert found.shape == (24, 3) and (same[:, 1] <= same[:, 0]).all() and (same[:, 2] <= same[:, 1]).all() and same[:, 0].any() and not same[:, 2].all()


def looked_up(code):
    """The global names that a function's code, or one within it, looks up."""
    inner = [looked_up(c) for c in code.co_consts if isinstance(c, CodeType)]
    return {i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL"}.union(*inner)


def test_near_duplicates_have_no_function_left_of_what_was_taken_out():
    """No sample is measured any more, so no function may call what measured it: all names that functions look up are there."""
    for name, f in vars(neardup).items():
        if isinstance(f, FunctionType) and f.__module__ == neardup.__name__:
            assert looked_up(f.__code__) <= set(vars(neardup)) | set(vars(builtins)), name


def test_shingles_and_counts():
    h = neardup.Hashes()
    assert len(neardup.shingles("a b c", 5, h)) == 1 and len(neardup.shingles("", 5, h)) == 0 == len(neardup.shingles(None, 5, h))
    assert neardup.set_key(neardup.shingles("A b, c d e f", 5, h)) == neardup.set_key(neardup.shingles("a b c d e f", 5, h))
    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(30), 20)), dtype=np.uint64) for _ in range(14)]
    weights = np.array([rng.randrange(1, 4) for _ in sets])
    similar = lambda x, y: len(set(x.tolist()) & set(y.tolist())) >= 0.6 * len(set(x.tolist()) | set(y.tolist()))
    for left in (14, 5):
        links, _ = neardup.counted(sets, left, weights, 0.6)
        pairs = [(i, j) for i in range(14) for j in range(14) if i != j and (left == 14 or (i < left) != (j < left))]
        want = [sum(weights[j] for i, j in pairs if i == k and similar(sets[i], sets[j])) for k in range(14)]
        assert links.tolist() == want


@pytest.mark.parametrize("text", ["token = 'abcdefgh'", "PASSWORD: x", "passwd=12345678 token: secret: abcdefghijk", "AKIA1234567890AB AKIA12", "é " + "0af" * 11, "api_key=ABCdef_.=-9", "to\u212aen=12345678"])
def test_base_secrets(text):
    import re

    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", m) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 8]
    found += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    want = sorted((m.start(), secrets.KINDS.index(k), m.end()) for k, m in found)
    assert [(s, k, e) for k, s, e in secrets.base_spans(text)] == want


def test_dense_strings():
    encode = secrets.encoding(open(RANKS, "rb").read()).encode_ordinary
    dense = lambda t: [t[a:b] for _, a, b in secrets.dense_spans(t, encode, 2.0, [])]
    key = "q8Xz4Lp0Wv7Rt2Yb9Kd1Nf6Hs3Jg5"
    assert dense(f"my {key} here") == [key]
    assert dense("d41d8cd98f00b204e9800998ecf8427e 123e4567-e89b-12d3-a456-426614174000 internationalisation_of_words_v2 aaaaaaaaaaaaaaaaaaaaaaaa 4041894974608795111122223333") == []
    assert secrets.masked("a KEY b KEY2", [(0, 2, 5), (3, 4, 5), (0, 8, 12)], "*") == "a * b *"


def test_random_strings_without_digits_are_found_and_names_are_not():
    encode = secrets.encoding(open(RANKS, "rb").read()).encode_ordinary
    dense = lambda t: secrets.dense_spans(t, encode, 2.0, [])
    rng = random.Random(14)
    for letters, least in (("abcdefghijklmnopqrstuvwxyz", 80), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 95), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 98)):
        assert sum(bool(dense("".join(rng.choices(letters, k=20)))) for _ in range(100)) >= least
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    assert sum(bool(dense("".join(rng.choices(base64, k=20)))) for _ in range(2000)) >= 1990
    assert dense("kdJfQ/xPqLmZrTyWvBnCj") == [(3, 0, 21)]
    names = "internationalisation_of_words_v2 getElementsByClassNameAndTag /usr/local/share/applications/files MAX_NUMBER_OF_CONNECTIONS_PER_HOST the-quick-brown-fox-jumps-over a/b/c/d/e/f/g/h/i/j/k/l --------------------------- counterrevolutionaries"
    assert [names[a:b] for _, a, b in dense(names)] == []


def test_pieces_parity():
    import sentencepiece

    data = open(PIECES, "rb").read()
    codec, theirs = pieces.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["", " ", "Hello world", "  two  spaces ", "tab\tand\nline", "naïve café 다중 🙂", "a" * 300, "<s> </s> <unk> <0x41>", "▁mark", "x  ", "\x00\x07", "Ünïcödé   ▁▁ mix"]
    rng = random.Random(4)
    texts += ["".join(rng.choices("ab cd▁eéß한🙂.\n<>/s0", k=rng.randrange(60))) for _ in range(150)]
    for text, (ids, same, back) in zip(texts, codec.encode(texts)):
        want = theirs.encode(text)
        assert np.frombuffer(ids, "<i4").tolist() == want, text
        assert same and codec.decode(ids) == theirs.decode(want) == text.replace("▁", " ") and back == ("▁" not in text)
    full = [e.ids for e in codec.full.encode_batch(texts, add_special_tokens=False)]
    assert [f for f, t in zip(full, texts) if t] == [theirs.encode(t) for t in texts if t]


def test_known_cuts_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 2000)
    codec = pieces.Codec(open(PIECES, "rb").read())
    for k in range(20):
        texts = [f"common w{k}x{i} {'z' * i}" for i in range(9)]
        found = codec.encode(texts)
        assert all(codec.decode(ids) == t and same and back for t, (ids, same, back) in zip(texts, found))
        assert codec.held == sum(pieces.OVERHEAD + 2 * len(c) + len(x) for c, x in codec.known.items()) and len(codec.known) < 60


def field(number, value):
    """One field of a protobuf message."""
    if isinstance(value, int):
        return bytes([number << 3 & 0x7F | 0x80, number >> 4, value]) if number > 15 else bytes([number << 3, value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3 | 2]) + bytes([len(value)]) + value


def unigram_model():
    """A small model file: unigram pieces, byte fallback, white space squeezed."""
    words = {"▁": -3.0, "▁the": -1.5, "the": -2.5, "▁cat": -2.0, "cat": -4.0, "s": -2.2, "c": -6.0, "a": -6.0, "t": -6.0, "h": -6.5, "e": -5.5, "▁th": -4.4, "at": -3.1}
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256)), *((w, x, 1) for w, x in words.items())]
    out = b"".join(field(1, field(1, w.encode()) + field(2, x) + field(3, k)) for w, x, k in rows)
    return out + field(2, field(3, 1) + field(35, 1)) + field(3, field(3, 1) + field(4, 1) + field(5, 1))


def test_a_unigram_model_with_byte_fallback_and_squeezed_spaces():
    import sentencepiece

    data = unigram_model()
    codec, theirs = pieces.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert codec.parsed.kind == pieces.UNIGRAM and codec.parsed.byte_fallback and not codec.wordy and codec.cuttable
    rng = random.Random(15)
    texts = ["the cats", "  the   cat ", "catthe é🙂", "", " ", "x", "cat\ncat"] + ["".join(rng.choices("the cats  é", k=rng.randrange(30))) for _ in range(200)]
    for text, (ids, same, back) in zip(texts, codec.encode(texts)):
        want = theirs.encode(text)
        assert same and np.frombuffer(ids, "<i4").tolist() == want, text
        assert codec.decode(ids) == theirs.decode(want) and back == (theirs.decode(want) == text), text


def test_model_file_errors():
    with pytest.raises((ValueError, IndexError)):
        pieces.parse(b"\x0b\x01nonsense")


def test_quality_model():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(300)]
    good = lambda: " ".join(rng.choices(words, k=60)).capitalize() + ". " + " ".join(rng.choices(words, k=9)) + "."
    bad = lambda: " ".join(w + "&&&" for w in rng.choices(words, k=60))
    positive, unlabelled = [good() for _ in range(400)], [good() if i % 4 else bad() for i in range(600)]
    model = quality.fit(positive, unlabelled)
    assert 0.6 < model.prior < 0.9
    score = lambda ts: model.score(np.array([quality.features(t) for t in ts]))
    assert (score([good() for _ in range(50)]) >= 0.7).mean() > 0.9 and (score([bad() for _ in range(50)]) < 0.7).mean() > 0.9
    assert all(0 <= s <= 1 for s in score(["", None, "\n", "🙂" * 50]))
    assert quality.fit([], []).score(np.array([quality.features("x")]))[0] == 0.5


def test_descent_reaches_the_least_non_negative_risk():
    rng = np.random.default_rng(7)
    p, u = rng.normal(1, 1, (300, 3)), np.vstack([rng.normal(1, 1, (280, 3)), rng.normal(-1, 1, (120, 3))])
    decay = 1e-3

    def risk(w, b, prior):
        """The risk as it is defined, text by text."""
        z = lambda x: sum(wi * xi for wi, xi in zip(w, x)) + b
        loss = lambda x, sign: math.log1p(math.exp(-sign * z(x)))
        plus, minus = sum(loss(x, 1) for x in p) / len(p), sum(loss(x, -1) for x in p) / len(p)
        unlabelled = sum(loss(x, -1) for x in u) / len(u)
        return prior * plus + max(0.0, unlabelled - prior * minus) + decay / 2 * sum(x * x for x in w)

    w, b = quality.descend(p, u, 0.7, 1500, 0.03, decay)
    best = risk(w, b, 0.7)
    for _ in range(25):
        assert best <= risk(w + rng.normal(0, 0.15, 3), b + rng.normal(0, 0.15), 0.7) + 1e-4


def test_dense_spans_skip_whatever_touches_another_span():
    encode = lambda s: s  # noqa: E731  every character a token
    rng = random.Random(18)
    for _ in range(200):
        text = " ".join("".join(rng.choices("aZ9kQ", k=rng.randrange(12, 40))) for _ in range(6))
        taken = [(0, a, a + rng.randrange(1, 30)) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(4)))]
        want = [(s, e) for _, s, e in secrets.dense_spans(text, encode, 2.0, []) if not any(s < b and a < e for _, a, b in taken)]
        assert [(s, e) for _, s, e in secrets.dense_spans(text, encode, 2.0, taken)] == want


def test_reliabilities_find_the_good_labelers():
    rng = random.Random(6)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.5
        vote = lambda p: (1 if y else -1) if rng.random() < p else (-1 if y else 1)
        key = (4, (0, vote(0.95), vote(0.9), vote(0.85), vote(0.5), 0, 1))
        counts[key] = counts.get(key, 0) + 1
    prob = pii.reliabilities(counts)
    assert prob[4, (0, 1, 1, 1, -1, 0, 1)] > 0.95 and prob[4, (0, -1, -1, -1, 1, 0, 1)] < 0.05
    w = pii.classifier({(*p, (i % 3, 1, 1, 1)): n for i, (p, n) in enumerate(counts.items())}, prob)
    z = lambda p: sum(a * b for a, b in zip(w, pii.features(p)))
    assert z((4, (0, 1, 1, 1, 0, 0, 1), (0, 1, 1, 1))) > 0 > z((4, (0, -1, -1, -1, 0, 0, 1), (0, 1, 1, 1)))
    assert pii.reliabilities({}) == {}


def plain_weak_supervision(candidates, rounds=60, steps=400):
    """The decision on each of (kind, votes, features), worked out candidate by candidate in plain loops."""
    squash = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    labelers = range(len(candidates[0][1]))
    belief = [1 / (1 + math.exp(-1.5 * sum(v))) for _, v, _ in candidates]
    for _ in range(rounds):
        said = {(c, k, v): 6.0 if (v > 0) == c else 2.0 for c in (True, False) for k in labelers for v in (1, -1)}
        for (_, votes, _), p in zip(candidates, belief):
            for k, v in enumerate(votes):
                if v:
                    said[True, k, v] += p
                    said[False, k, v] += 1 - p
        share = {at: n / (n + said[at[0], at[1], -at[2]]) for at, n in said.items()}
        new = [squash(sum(math.log(share[True, k, v] / share[False, k, v]) for k, v in enumerate(votes) if v)) for _, votes, _ in candidates]
        moved = max(abs(a - b) for a, b in zip(belief, new))
        belief = new
        if moved < 1e-9:
            break
    seen = {}
    for c, p in zip(candidates, belief):
        seen[c] = (p, seen.get(c, (p, 0))[1] + 1)
    marks = lambda c: ["always", ("kind", c[0]), *(("vote", k, v) for k, v in enumerate(c[1]) if v), *(("feature", k, v) for k, v in enumerate(c[2]))]
    weight, total = {}, sum(math.log1p(n) for _, n in seen.values())
    score = lambda c: sum(weight.get(m, 0.0) for m in marks(c))
    for _ in range(steps):
        step = {m: 0.002 * w for m, w in weight.items()}
        for c, (p, n) in seen.items():
            for m in marks(c):
                step[m] = step.get(m, 0.0) + math.log1p(n) * (squash(score(c)) - p) / total
        for m, g in step.items():
            weight[m] = weight.get(m, 0.0) - g
    return {c: score(c) for c in seen}


def test_fitted_classifier_equals_plain_loops():
    rng = random.Random(31)
    for size in (1, 40, 400):
        candidates = []
        for _ in range(size):
            kind, y = rng.randrange(len(pii.KINDS)), rng.random() < 0.6
            votes = tuple(rng.choice((0, (1 if y else -1) if rng.random() < 0.8 else (-1 if y else 1))) for _ in pii.LABELERS)
            candidates.append((kind, votes, tuple(rng.randrange(n) for n in pii.FEATURES.values())))
        want = plain_weak_supervision(candidates)
        full, counts = {}, {}
        for c in candidates:
            full[c], counts[c[:2]] = full.get(c, 0.0) + 1, counts.get(c[:2], 0.0) + 1
        w = pii.classifier(full, pii.reliabilities(counts))
        assert all(abs(sum(a * b for a, b in zip(w, pii.features(c))) - z) < 1e-6 for c, z in want.items())
    assert set(pii.classifier({}, {})) == {0.0}
