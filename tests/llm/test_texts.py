"""Problems 4, 8, 9 and 10: stated cases, brute force and edge cases."""

import os
import random

import numpy as np
import pytest

from hazardloom.llm import leaks, mixing, personal, sentences
from hazardloom.storage import Workspace


@pytest.mark.parametrize(
    "text, want",
    [
        ("Contact I. Bhalorkar at torben+hse@rig7.example.org or 5552710573 for it.", [("NAME", "I. Bhalorkar"), ("EMAIL", "torben+hse@rig7.example.org"), ("PHONE", "5552710573")]),
        ("Mr. CORWEN CRESTAVIN was standing there.", [("NAME", "CORWEN CRESTAVIN")]), ("Reported by maelis ostrander-quill.", [("NAME", "maelis ostrander-quill")]), ("Supervisor marrick teldrin refused it.", [("NAME", "marrick teldrin")]),
        ("Reported by: Saltverin, Hollis, ZZZPK2503Q.", [("NAME", "Saltverin, Hollis"), ("ID", "ZZZPK2503Q")]), ("Please send photos to jach [at] mail [dot] example [dot] com.", [("EMAIL", "jach [at] mail [dot] example [dot] com")]),
        ("He lives at Flat 5A, 514 Pellow Lane, Devtara 000514 and was sent home.", [("ADDRESS", "Flat 5A, 514 Pellow Lane, Devtara 000514")]), ("Sent to 645 Corvid Road\nNalbasti 00645, tel. 555.177.2693.", [("ADDRESS", "645 Corvid Road\nNalbasti 00645"), ("PHONE", "555.177.2693")]),
        ("to H.No. 290, Kelmar Road, Ward 11, Nalbasti - 000290.", [("ADDRESS", "H.No. 290, Kelmar Road, Ward 11, Nalbasti - 000290")]), ("Called +1 (942) 555-0165, no answer.", [("PHONE", "+1 (942) 555-0165")]), ("Called 205 555 0189 ext. 181, no answer.", [("PHONE", "205 555 0189 ext. 181")]),
        ("Badge EMP 974019 does not match.", [("ID", "EMP 974019")]), ("see also OILID: 596379", [("ID", "OILID: 596379")]), ("National ID 0161 2497 1004 was written.", [("ID", "0161 2497 1004")]), ("घटना के समय रवीशा वेलकर ने वाल्व बंद किया।", [("NAME", "रवीशा वेलकर")]),
        ("Drawing 4973-45-7168 and Cylinder batch 2047-7921-4, Work order 287447163299, serial no. 12345678901, Coordinates 12.3492, 77.2155 on 03.11.2024.", []),
        ("The contractor on site was Harlan Creek Pipeline Inc. The Safety Officer of St. Aldric crew was there.", []), ("Ask the shift supervisor.", []), ("", []), (None, []), ("@", []), ("a@", []), ("meet at dot", []),
    ],
)
def test_personal(text, want):
    got = personal.find_personal(text)
    assert [(k, text[a:b]) for k, a, b in got] == want


#: Frames, languages and number styles that the operator's cue lists don't name one by one: [..] marks what is personal.
HELD_OUT = """NAME Yesterday [John Smith] fell from the ladder.
NAME The victim, [Priya Sharma], was taken to hospital.
NAME Nurse [Anna Kowalska] treated him at once.
NAME After the shift [Carlos Mendez] said the hose was old.
NAME The hose struck [Peter O'Brien] on the hand.
NAME [Fatima Hassan] slipped on the wet deck and broke an arm.
NAME A call came from [Luis Ortega], who saw the smoke.
NAME The apprentice [Tomasz Zielinski] had no gloves.
NAME Our colleague [Sven Lindqvist] noticed the leak first.
NAME The burns of [Ahmed Mansour] were treated on site.
NAME We thanked [Julia M. Peters] for the report.
NAME [Wei Zhang] climbed the tower without a harness.
NAME The injured welder [Marco Bellini] walked to the clinic.
NAME Then [Robert Kincaid] lifted the flange alone.
NAME [Grethe Solheim] refused the job.
NAME [张伟]在现场受伤。
NAME 昨天，[李小红]说阀门没有关。
EMAIL Write to [o'neil.j@sub.example.co.uk], he knows more.
EMAIL Mail: [first_last99@example.org]
EMAIL It went to [ops at example dot com] by mistake.
EMAIL Send it to [jane(at)example(dot)net] please.
PHONE Ring [+49 30 1234567] for the key.
PHONE Call [01 42 68 53 00] after six.
PHONE Mobile [+44 7911 123456] is always on.
PHONE Tel. [(0171) 234 5678] rings at the gate.
PHONE The number is [+91-98765-43210] now.
PHONE Phone number [432-555-0123] was left.
PHONE Fax: [030/1234567] as ever.
ID Passport no. [X1234567] was copied.
ID His SSN is [123-45-6789] on the form.
ID Aadhaar [1234 5678 9012] on the card.
ID Employee ID: [88412] was shown.
ID Driving licence no. [SMITH70615] expired.
ID PAN card [ABCDE1234F] was attached.
ID Badge no. [48213] opened the gate.
ADDRESS He lives at [12 Rue de la Paix, 75002 Paris] now.
ADDRESS Wohnhaft [Hauptstraße 12, 10115 Berlin] seit Mai.
ADDRESS Vive en [Calle Mayor 5, 28013 Madrid] con su familia.
ADDRESS She moved to [1200 Main Dr, Houston] last year.
ADDRESS Post goes to [77 Oak Square, Leeds 48213] only."""
IMPERSONAL = """The contractor on site was Harlan Creek Pipeline Inc. and Blue Quarry Inspection Ltd.
Night Shift Report of Kestrel Tank Farm, Valve Pit 3.
The Safety Officer signed the Hot Work Permit at North Dock.
Pressure rose from 485.2 bar to 576 bar on 2024-03-11 at 10:55.
Drawing 4973-45-7168, batch 2047-7921-4, order 287447163299, serial no. 12345678901.
Line of Fire and Energy Isolation were discussed. Selwyn Ridge Station was shut.
See Fig. 8 of Procedure HSE-1205. The Gas Tester left the Rig Floor.
On the road to the plant, the main street and the way back were wet.""".splitlines()


def test_personal_off_the_known_frames():
    """Recall of at least nine tenths on held-out frames, languages and number styles, and nothing in impersonal ones."""
    cases = [line.split(" ", 1) for line in HELD_OUT.splitlines()]
    hit = 0
    for kind, marked in cases:
        text, a, b = marked.replace("[", "").replace("]", ""), marked.index("["), marked.index("]") - 1
        hit += any(k == kind and x <= a and y >= b and (y - x) <= (b - a) + 14 for k, x, y in personal.find_personal(text))
    assert hit >= 0.9 * len(cases), hit
    assert [personal.find_personal(t) for t in IMPERSONAL] == [[]] * len(IMPERSONAL)


def test_names_learnt_from_texts(spark):
    """A context that only the texts themselves show to be one of names."""
    surnames = ["Orvelle", "Quennick", "Doluwala", "Haddlemoor", "Tolvanik"]
    rows = [("t", str(k), f"Mr. Kirti {surnames[k % 5]} zorped again. Harlan {['Creek', 'Basin'][k % 2]} Pipeline stood still.", "x") for k in range(200)]
    texts = spark.createDataFrame(rows, "source_table string, record_id string, text string, bin string")
    evidence = personal.learn_names(texts)
    probe = "On Monday Anvika Sundrani zorped again."
    assert personal.find_personal(probe) == [] and personal.find_personal("Harlan Reach zorped again.", evidence) == []
    assert [(k, "On Monday Kirti Sundrani zorped again."[a:b]) for k, a, b in personal.find_personal("On Monday Kirti Sundrani zorped again.", evidence)] == [("NAME", "Kirti Sundrani")]
    assert not personal.learn_names(texts.limit(0)).any()


def test_boundaries_without_windows():
    local, name = "a" * 300, "A" + "b" * 400
    text = f"Mail {local}@example.org or {name} Smith says no. He lives at 12 {name} Road, {name} 75002 now."
    got = [(k, text[a:b]) for k, a, b in personal.find_personal(text)]
    assert ("EMAIL", f"{local}@example.org") in got and ("NAME", f"{name} Smith") in got and ("ADDRESS", f"12 {name} Road, {name} 75002") in got


def test_redaction_and_long_text():
    text = "Called 5556101159, no answer. " * 20_000
    out = personal.redact(text)
    assert out == "Called [PHONE], no answer. " * 20_000
    assert personal.find_personal("x" * 300_000) == []


def test_personal_in_spark(spark):
    df = spark.createDataFrame([("1", "Ask A. Teldrin (x@y.example).", "z"), ("1", "Ask A. Teldrin (x@y.example).", "z"), ("2", None, "z"), (None, "Ask A. Teldrin.", "z")], "id string, text string, start_char string")
    got = personal.places(personal.union_texts((df, "reports", "id", "text")))
    assert sorted(map(tuple, got.collect())) == [("reports", "1", "EMAIL", 16, 27), ("reports", "1", "NAME", 4, 14)]
    assert personal.places(personal.union_texts((df.limit(0), "reports", "id", "text"))).count() == 0


WORDS = ["valve", "pump", "seal", "gauge", "crew", "dock", "sand", "filter", "hose", "audit", "night", "steward", "panel", "locker", "record", "vent", "mast", "trap", "drill", "study"]


def test_leaks_by_brute_force(spark):
    rng = random.Random(7)
    passages = [[rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(60)] for _ in range(12)]
    docs, want = [], set()
    for k in range(150):
        p = rng.randrange(12)
        size, edits = rng.choice([(11, 0), (12, 0), (13, 0), (24, 2), (30, 3), (24, 4), (40, 4), (23, 2)])
        a = rng.randrange(60 - size + 1)
        part = passages[p][a : a + size]
        spots = sorted(rng.sample(range(2, size - 2), edits))
        for s in spots:
            part[s] = "changed"
        docs.append((k, "start here. " + " ".join(part).upper() + ", end; " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(80))), "x"))
        runs = max(len(r.split()) for r in " ".join(part).split("changed"))
        best = any(passages_ok(spots, size, i, j) for i in range(size) for j in range(i + 24, size + 1))
        if runs >= 12 or best:
            want.add((k, p))
    docs += [(900, None, "x"), (901, "", "x"), (902, " ".join(passages[0][:14]), "x"), (902, " ".join(passages[0][:14]), "x")]
    want.add((902, 0))
    items = spark.createDataFrame([(k, "en", " ".join(p), "s") for k, p in enumerate(passages)] + [(99, "en", None, "s"), (98, "zh", "短", "s")], "item_id long, lang string, passage string, text string")
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), items).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    sharded = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), items, shard_chars=900).collect()
    assert set(map(tuple, sharded)) == want
    assert leaks.find_leaks(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
    assert leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), items.limit(0)).count() == 0


def passages_ok(spots, size, i, j):
    inner = [s for s in spots if i <= s < j]
    return i not in inner and j - 1 not in inner and 10 * len(inner) <= j - i


def test_chinese_leaks(spark):
    rng = random.Random(8)
    chars = [chr(0x4E00 + rng.randrange(800)) for _ in range(120)]
    passage = "".join(chars)
    docs = [(1, "前文。" + "，".join(passage[40:70]) + "后文", ""), (2, passage[40:69], ""), (3, passage, "")]
    items = spark.createDataFrame([(5, "zh", passage)], "item_id long, lang string, passage string")
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string, x string"), items)
    assert sorted(map(tuple, got.collect())) == [(1, 5), (3, 5)]


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="tokenizer file absent")
def test_mixing(spark):
    rng = random.Random(9)
    docs = [(k, rng.choice(["A", "a ", "b", "c", "none"]), "word " * rng.randrange(1, 200)) for k in range(3000)] + [(9001, None, "x"), (9002, "a", None), (9003, "b", "")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 3), ("c", 0.2, 4), ("b", 0.3, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), targets, Workspace(spark, "t"))
    rows = mixed.collect()
    assert len(rows) == len(docs)
    caps = {"a": 1, "b": 3, "c": 4}
    assert all(0 <= r["copies"] <= caps.get(r["source"], 0) for r in rows)
    shares = {r["source"]: (r["target_share"], r["actual_share"]) for r in report.collect()}
    assert all(abs(t - x) < 0.01 for t, x in shares.values())
    # the dual solution: the log of an uncapped rate is linear in the document's tokens
    some = [(r["n_tokens"], r["rate"]) for r in rows if r["source"] == "c" and 0 < r["rate"] < 4]
    import math

    slopes = {round(math.log(rate) / n, 6) for n, rate in some}
    assert len(slopes) == 1
    more, short = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), targets, Workspace(spark, "t"), total=10**9)
    assert min(r["shortfall_tokens"] for r in short.filter("target_share > 0").collect()) > 0
    empty, _ = mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string"), targets, Workspace(spark, "t"))
    assert empty.count() == 0


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="tokenizer file absent")
def test_tokens_of_long_texts():
    enc = mixing.encoder(mixing.TOKENIZER)
    rng = random.Random(2)
    texts = ["abcde fghij " * 35_001, "x" * 450_000, "पानी  की\n\n टंकी\t" * 30_000, "".join(rng.choice("ab, .\n  'st") for _ in range(450_000)), ""]
    for t in texts:
        assert mixing.count_tokens(enc, t) == len(enc.encode_ordinary(t))
        assert mixing.count_tokens(enc, t[:5000], piece=7) == len(enc.encode_ordinary(t[:5000]))


def units(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, stop string")
    out = {}
    for r in sentences.sentences(df, Workspace(spark, "t")).collect():
        out.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    return {k: [texts[k][a:b] for a, b in sorted(v)] for k, v in out.items()}


def test_sentences(spark):
    base = ["The pump was closed. The crew left the site.\n\nThe valve was opened by hand. Nobody was hurt.", "See Fig. 4 of the plan. The leak was approx. 5 litres.\n\nIt was found later. The crew met Dr. Smith at noon."] * 40
    texts = base + [
        "Heading\n\nOne line\nwrapped here.  Next one! ", '"Keep clear!" shouted the rigger. He asked, "Is it closed?", but got no answer. (All was well.) Done.', "他说:“没有人检查。”请先隔离，再开始！谁打开了？", "「止めろ。」と叫んだ。次の文だ。",
        "ปิดวาล์วแล้ว แจ้งห้อง อุปกรณ์ต่างๆ ที่นี่ ตรวจ GC-1 ก่อน", "परमिट यहाँ था। काम रुका! वह गया|", "", None, "   \n \n ", "cut off at the en", "Gas was 3.5 bar. Then v4.1.36 was loaded.", "The crew left the site.The pump was closed.",
    ]
    got = units(spark, texts)
    n = len(base)
    assert got[0] == ["The pump was closed.", "The crew left the site.", "The valve was opened by hand.", "Nobody was hurt."]
    assert got[n] == ["Heading", "One line\nwrapped here.", "Next one!"]
    assert got[n + 1] == ['"Keep clear!" shouted the rigger.', 'He asked, "Is it closed?", but got no answer.', "(All was well.)", "Done."]
    assert got[n + 2] == ["他说:“没有人检查。”", "请先隔离，再开始！", "谁打开了？"]
    assert got[n + 3] == ["「止めろ。」と叫んだ。", "次の文だ。"]
    assert got[n + 4] == ["ปิดวาล์วแล้ว", "แจ้งห้อง", "อุปกรณ์ต่างๆ ที่นี่", "ตรวจ GC-1 ก่อน"]
    assert got[n + 5] == ["परमिट यहाँ था।", "काम रुका!", "वह गया|"]
    assert n + 6 not in got and n + 7 not in got and n + 8 not in got
    assert got[n + 9] == ["cut off at the en"] and got[n + 10] == ["Gas was 3.5 bar.", "Then v4.1.36 was loaded."] and got[n + 11] == ["The crew left the site.", "The pump was closed."]
    assert units(spark, []) == {}


def test_copies_are_no_evidence(spark, monkeypatch):
    """The model reads each text once, so a repeated table gives the units of one copy; a hot text is dealt over salts."""
    base = ["The crew saw the pump. It was shut.\n\nThe rigger left.", "Men ran to the ledge. Xenon was let out of flask no. 4. Yet all went well.", "Heading"]
    read, gaps = [], sentences.gaps
    monkeypatch.setattr(sentences, "gaps", lambda docs: read.append(docs.count()) or gaps(docs))
    once = units(spark, base)
    monkeypatch.setattr(sentences, "HOT_ROWS", 5, raising=False)
    monkeypatch.setattr("hazardloom.operators.skew.HOT_ROWS", 5)
    many = units(spark, base * 7)
    assert read == [3, 3] and len(many) == 21 and all(many[k] == once[k % 3] for k in many)


def test_posteriors_by_brute_force():
    """Forward-backward over documents of any size against the sum over all event sequences."""
    import itertools

    rng = np.random.default_rng(3)
    sizes = np.array([3, 0, 1, 5, 2, 0])
    n = int(sizes.sum())
    score, distance = rng.normal(size=n) * 2, rng.integers(0, sentences.DISTANCES, n)
    chain = rng.normal(size=(2, sentences.DISTANCES))
    post, tells = sentences.forward_backward(score, distance, sizes, chain)
    at = 0
    for size in sizes.tolist():
        total, yes, told = 0.0, np.zeros(size), np.zeros((size, 4))
        for events in itertools.product((0, 1), repeat=size):
            w = np.exp(sum(e * (score[at + k] + (chain[events[k - 1], distance[at + k]] if k else 0.0)) for k, e in enumerate(events)))
            total += w
            yes += w * np.array(events)
            for k in range(1, size):
                told[k, 2 * events[k - 1]] += w * events[k]
                told[k, 2 * events[k - 1] + 1] += w
        assert np.allclose(post[at : at + size], yes / total) and np.allclose(tells[at : at + size], told / total)
        at += size


def test_unpunctuated_text(spark):
    """What is learnt from texts with marks parts a text without any; short headings stay whole."""
    openings = ["The pump was closed", "The crew left the site", "Nobody was hurt", "Workers checked the valve", "Later the gauge was read"]
    rng = random.Random(4)
    base = [" ".join(f"{s}." for s in rng.sample(openings, 5)) + "\n\n" + rng.choice(openings) + "." for _ in range(400)]
    bare = " ".join(openings + openings[:3])
    got = units(spark, base + [bare, "Report of the night shift", "A" * 400, "word " * 20])
    assert got[400] == openings + openings[:3] and got[401] == ["Report of the night shift"] and got[402] == ["A" * 400] and len(got[403]) == 1


def test_words_and_places_of_any_length():
    long = "x" * 5000
    rows = sentences.scan(f"{long}. {long}y. Then it began.")
    other = sentences.scan(f"{long}. {long}z. Then it began.")
    assert rows[1][4] == other[1][4] and rows[1][5] != other[1][5] and rows[2][4] != other[2][4]
    assert len(sentences.scan("a." * 100_000)) >= 1


def test_long_text(spark):
    text = "The pump was closed. " * 30_000
    assert len(units(spark, [text])[0]) == 30_000
