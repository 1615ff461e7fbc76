import random

from pyspark.sql import functions as F

from quaymark.llm.boilerplate import openers
from quaymark.llm.leakage import Items, leaks
from quaymark.llm.subtitles import MISREAD, opener, repaired, skeleton, spoken
from quaymark.llm.wumanber import Patterns, _words, padded


def words(text):
    return [w[0] for w in spoken(text)]


def test_structure_goes():
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\n- <i>Hello,</i> it's me.\r\n\r\n00:00:03,000 --> 00:00:04,000\r\n[door\r\ncreaks] NARRATOR: Time goes\r\n\r\n7\r\n00:00:04,000 --> 00:00:01,000\r\n{\\an8}(rain)\r\nby fast ♪ la la ♪\r\n\r\n8\r\n00:00:05,000 --> 00:00:06,000\r\nCaptions by somebody\r\n\r\n9\r\n00:00:07,000 --> 00:00:08,000\r\nGet more at www.site.example now\r\n\r\n10\r\n00:00:07,000 --> 00:00:08,000\r\nin 1984 *sighs* here"
    assert words(srt) == "hello its me time goes by fast in 1984 here".split()
    vtt = "WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:02.000 align:start position:46%\nOne two\n\n00:02.000 --> 00:03.000\nthree"
    assert words(vtt) == ["one", "two", "three"]
    assert words(None) == words("") == words(" \n\r\n") == words("1\n00:00:01,000 --> 00:00:02,000\n") == []
    assert words("no cues at all") == ["no", "cues", "at", "all"]


def test_roll_up_counts_once():
    cue = lambda i, *lines: f"{i}\n00:00:0{i},000 --> 00:00:0{i},900\n" + "\n".join(lines) + "\n\n"
    text = cue(1, "we go") + cue(2, "we go", "to the sea") + cue(3, "to the sea", "[wind]") + cue(4, "[wind]", "t0 thc sca", "and back") + cue(5, "and back") + cue(6, "we go")
    assert words(text) == "we go to the sea t0 thc sca and back we go".split() or words(text) == "we go to the sea and back we go".split()


def test_encodings():
    s = "Dónde está el baño à la fenêtre"
    assert repaired(s.encode().decode("latin-1")) == repaired(s) == s
    assert repaired(s.encode().decode("latin-1").encode().decode("latin-1")) == s
    assert repaired("café mañana".encode("latin-1").decode("cp1251")) == "café mañana"
    assert repaired("hоusе".replace("е", "e")) == "house"
    assert repaired("plain") == "plain"


def test_skeletons_survive_damage():
    rng = random.Random(0)
    for w in ["never", "carried", "window", "umweltverträglichkeit", "mañana", "the", "swim", "unofficial"]:
        for _ in range(30):
            hurt = "".join(rng.choice(MISREAD[c]) if c in MISREAD and rng.random() < 0.3 else c for c in w)
            assert skeleton(hurt) == skeleton(w), (w, hurt)
        assert skeleton("".join("�" if not c.isascii() else c for c in w)) == skeleton(w)


def test_search_finds_what_a_naive_one_does():
    rng = random.Random(4)
    text = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    for m in (1, 2, 3, 7, 20):
        for size in (0, 5, 100, 3000):
            pats = [text(rng.randint(m, m + 5)) for _ in range(25)]
            data = b"\0".join([text(rng.randint(0, size)) for _ in range(8)] + rng.choices(pats, k=3))
            start, k = Patterns(pats).find(padded(data))
            want = sorted((s, j) for j, p in enumerate(pats) for s in range(len(data) - len(p) + 1) if data.startswith(p, s))
            assert list(zip(start.tolist(), k.tolist())) == want


def test_search_skips():
    rng = random.Random(5)
    text = lambda n: bytes(rng.choice(b"bgjkpqrtvxyzn") for _ in range(n))
    known = Patterns([text(60) for _ in range(300)])
    data = padded(text(200_000))
    _, looked = known.ends(_words(data), 200_000)
    assert looked < 200_000 / 10


VOCAB = "lantern mountain opened market soldier yellow bridge table promise paper factory village dinner question cellar island harbour window stranger garden".split()


def brute(docs, items, share=0.6):
    out = set()
    for d, dw in docs:
        for i, iw in items:
            need = -(-len(iw) * 6 // 10)
            runs = {tuple(dw[a : a + need]) for a in range(len(dw) - need + 1)}
            if any(tuple(iw[a : a + need]) in runs for a in range(len(iw) - need + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, [rng.choice(VOCAB) for _ in range(rng.randint(5, 30))]) for i in range(25)]
    docs = []
    for d in range(120):
        w = [rng.choice(VOCAB) for _ in range(rng.randint(0, 60))]
        if d % 2:
            _, iw = rng.choice(items)
            n = max(1, round(len(iw) * rng.choice([0.4, 0.5, 0.6, 0.7, 1.0])))
            a = rng.randint(0, len(iw) - n)
            w[10:10] = iw[a : a + n]
        docs.append((d, w))

    def cued(w):
        out, i = [], 0
        while i < len(w):
            n = rng.randint(1, 6)
            out.append(f"{len(out) + 1}\n00:00:01,000 --> 00:00:02,000\n{' '.join(w[i : i + n]).upper() if i % 2 else ' '.join(w[i : i + n])},\n")
            i += n
        return "\n".join(out)

    dd = spark.createDataFrame([(d, cued(w), 1) for d, w in docs] + [(500, None, 1), (501, "", 1)], "doc_id bigint, text string, item_id int")
    ii = spark.createDataFrame([(i, "  ".join(w) + ".", 1) for i, w in items] + [(900, None, 1), (901, " - ", 1)], "item_id bigint, text string, doc_id int")
    for block, side in ((40, 2), (60, 100), (10**6, 1)):
        got = {(r.doc_id, r.item_id) for r in leaks(dd, ii, doc_id=F.col("doc_id"), text=F.col("text"), item_id=F.col("item_id"), item_text=F.col("text"), block_words=block, side_by_side=side).collect()}
        assert got == brute(docs, items)
    none = dd.limit(0)
    assert leaks(none, ii, doc_id=F.col("doc_id"), text=F.col("text"), item_id=F.col("item_id"), item_text=F.col("text")).count() == 0
    assert leaks(dd, ii.limit(0), doc_id=F.col("doc_id"), text=F.col("text"), item_id=F.col("item_id"), item_text=F.col("text")).count() == 0


def test_damaged_and_long():
    item = "nobody from the village had watched the market so we walked back to the clever promise à midi"
    known = Items([(7, item)])
    hurt = "n0body frorn thc villagc liad vvatclied f�c markef so wc walkcd back to the clcver prornise � midi"
    far = " ".join(["window"] * 200_000)
    docs = [spoken(hurt), spoken(f"{far}\n{item}\n{far}"), spoken("nobody from the village had watched the island so we walked on")]
    assert known.search(docs) == [(0, 7), (1, 7)]
    assert known.search([[]]) == [] and known.search([]) == []


def test_words_without_steady_consonants():
    known = Items([(1, "he will do all he had")])
    assert known.search([spoken("i said he will do all he had to")]) == [(0, 1)]
    known = Items([(2, "la la la")])
    assert known.search([spoken("oh la la la oh"), spoken("oh la")]) == [(0, 2)]


def test_sharp_s_in_capitals():
    item = "der grundsatz der verhältnismäßigkeit verlangt daß jede straße außer der größten gemessen und geschlossen wird"
    docs = [item, item.upper(), item.upper().replace("SS", "ẞ"), item.replace("ß", "ss"), item.replace("ß", "�"), item.replace("ß", "s5"), item.replace("ß", "ÃŸ"), item.replace("jede", "keine").upper()]
    want = [(d, 1) for d in range(7)]
    for text in (item, item.upper()):
        assert Items([(1, text)]).search([spoken(d) for d in docs]) == want
    assert skeleton("messstelle") == skeleton("me�stelle") == skeleton("meßstelle") and skeleton("mess") != skeleton("mes")


def test_questions_after_a_lost_dash_stay():
    cue = "\n\n1\n00:00:01,000 --> 00:00:02,000\n"
    assert words(cue + "? Non, le nid !" + cue + "? Où est le sac ?\n? Voici le chien.") == "non le nid où est le sac voici le chien".split()
    assert words(cue + "? Voici le chien." + cue + "Où est-il ?" + cue + "? Où est le sac ?") == "voici le chien où est-il où est le sac".split()
    assert words(cue + "? We ran" + cue + "? la la, low tide ?" + cue + "Where is it?") == "we ran where is it".split()
    assert words(cue + "Où est-il ?" + cue + "? la la ?" + cue + "- ? la la ?" + cue + "� la la �") == "où est-il".split()
    assert words(cue + "? We ran\nhome ?" + cue + "? la la ?") == "we ran home".split()
    assert words(cue + "? Non !" + cue + "- ? la la ?" + cue + "� la la �" + cue + "? Où ?") == "non où".split()


def test_words_split_and_joined():
    item = "because the lantern of the village had opened another question about yellow mountains we remember"
    want = item.split()
    rng = random.Random(6)
    for _ in range(40):
        w = list(want)
        i = rng.choice([x for x in range(len(w)) if len(w[x]) > 3])
        cut = rng.randint(1, len(w[i]) - 1)
        split = w[:i] + [w[i][:cut], w[i][cut:]] + w[i + 1 :]
        j = rng.randrange(len(w) - 1)
        joined = w[:j] + [w[j] + w[j + 1]] + w[j + 2 :]
        for text in (split, joined):
            assert Items([(3, item)]).search([spoken("so he said " + " ".join(text) + " and left")]) == [(0, 3)], text
    assert Items([(3, item)]).search([spoken("so " + " ".join(want[:6] + ["window"] + want[8:]))]) == []


def test_long_markup_and_sounds_go():
    long = "w " * 400
    assert words(f"00:00:01,000 --> 00:00:02,000\n<font {long}>one</font> [{long}] two ({long}) three *{long}* four #{long}# five") == "one two three four five".split()


def test_adverts_are_learned_from_where_they_stand(spark):
    rng = random.Random(11)
    item = "because the lantern of the village had opened another question about yellow mountains we remember"
    docs = []
    for d in range(130):
        lines = [" ".join(rng.choice(VOCAB) for _ in range(4)) for _ in range(16)]
        lines[8:8] = ["soldier bridge opened here"]  # speech that many files have, in their midst
        if d % 2:
            lines.insert(rng.choice([0, 1, len(lines) - 1]), f"Proudly transcribed tonight for {rng.choice(VOCAB)} fans")
        if d == 7:
            w = item.split()
            lines += [" ".join(w[:7]), "Proudly transcribed tonight", " ".join(w[7:])]
        docs.append((d, "\n".join(f"{i}\n00:00:01,000 --> 00:00:02,000\n{x}\n" for i, x in enumerate(lines)), f"t{d % 20}"))
    dd = spark.createDataFrame(docs, "doc_id bigint, text string, title string").repartition(3)
    known = openers(dd, F.col("text"), F.col("title"))
    assert known == {opener(spoken("proudly transcribed"))}
    assert openers(dd, F.col("text"), F.lit("one title")) == openers(dd.limit(0), F.col("text"), F.col("title")) == frozenset()
    ii = spark.createDataFrame([(3, item)], "item_id bigint, text string")
    found = lambda **kw: [tuple(r) for r in leaks(dd, ii, doc_id=F.col("doc_id"), text=F.col("text"), item_id=F.col("item_id"), item_text=F.col("text"), **kw).collect()]
    assert found() == [] and found(adverts=known) == [(7, 3)]
