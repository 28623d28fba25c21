import random

import numpy as np

from tidemark.llm import leakage as L

DOCS = "doc_id long, text string, item_id string, share string"
ITEMS = "item_id long, item_text string, preface string"
WORDS = [f"w{k}" for k in range(400)]


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(k, t, "x", "y") for k, t in docs], DOCS).repartition(2)
    i = spark.createDataFrame([(k, t, "stock wording") for k, t in items], ITEMS)
    return {(r.doc_id, r.item_id) for r in L.leaked_items(d, "doc_id", "text", i, "item_id", "item_text", **kw).collect()}


def sentence(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def test_variants_of_a_leak(spark):
    rnd = random.Random(8)
    item = sentence(rnd, 60)
    other = sentence(rnd, 60)
    text = " ".join(item)
    around = lambda t: " ".join(sentence(rnd, 50)) + "\n" + t + " " + " ".join(sentence(rnd, 50))
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)
    replaced = [("zzz" if k % 7 == 3 else w) for k, w in enumerate(item)]
    torn = item[:30] + [f"f{k}" for k in range(25)] + item[30:]
    docs = [
        (1, around(text)), (2, around(text.upper())), (3, around(wide)), (4, around("> " + "\n> ".join(item[k] for k in range(60)))),
        (5, around("​".join(text))), (6, around(" ".join(item))), (7, around(" ".join(replaced))), (8, around(" ".join(torn))),
        (9, around(" ".join(item[20:47]))), (10, around(", ".join(f'"{w}"' for w in item))), (11, around("\\n".join(item))), (12, text), (12, text),
        (20, around(" ".join(item[20:40]))), (21, around(" ".join(sorted(item)))), (22, around("stock wording")), (23, around(" ".join(item[::-1]))),
        (24, None), (25, ""), (26, "   "), (27, " ".join(item[:5]) * 3),
    ]
    assert leaks(spark, docs, [(100, text), (101, " ".join(other)), (102, None), (103, "")]) == {(k, 100) for k in range(1, 13)}


def spread(words, runs):
    """A foreign word after every run of words, the runs' lengths in turn."""
    out, at, k = [], 0, 0
    while at < len(words):
        out += [*words[at : at + runs[k % len(runs)]], f"foreign{k}"]
        at, k = at + runs[k % len(runs)], k + 1
    return out


def test_foreign_words_between_few_words(spark):
    rnd = random.Random(15)
    item = [f"i{k}" for k in range(100)]
    around = lambda t: " ".join([*sentence(rnd, 60), *t, *sentence(rnd, 60)])
    docs = [
        (1, around(spread(item, [2]))), (2, around(spread(item, [1]))), (3, around(spread(item[30:71], [3, 2]))), (4, around(spread(item[30:71], [2]))),
        (5, around(spread(item[30:71], [1]))), (20, around(spread(item[30:65], [3, 2]))), (21, around(spread(item[::-1], [1]))),
    ]
    assert leaks(spark, docs, [(1, " ".join(item))]) == {(k, 1) for k in range(1, 6)}


def test_stretches_with_replaced_words():
    rnd = random.Random(17)
    stock = ["the", "of", "a", "in"]
    item = [rnd.choice(stock) if k % 3 == 1 else f"i{k}" for k in range(100)]
    index = L.ItemIndex([(1, " ".join(item))])
    host = lambda: [rnd.choice(stock) if rnd.random() < 0.2 else f"h{rnd.randrange(500)}" for _ in range(60)]
    code = lambda words: np.array([index.vocabulary.get(w, 0) for w in words], np.int32)
    docs = {}
    for size in range(40, 48):
        for every in (4, 5):
            for at in range(every):
                begin = rnd.randrange(100 - size)
                stretch = [f"z{k}" if k % every == at else item[begin + k] for k in range(size)]
                docs[size, every, at] = code([*host(), *stretch, *host()])
    docs["few"] = code([*host(), *item[30:55], *host()])
    got = {d[0] for d in L.shard_leaks(list(docs.items()), index)}
    assert got == set(docs) - {"few"}


def test_stretch_far_from_its_verbatim_matches():
    index = L.ItemIndex([(1, " ".join(f"i{k}" for k in range(100)))])
    text = [*range(1, 26), *[x for k in range(26, 42) for x in (*[0] * 20, k)], *[0] * 400]
    (found,) = L.shard_leaks([(7, np.array([0] * 400 + text, np.int32))], index)
    assert found == (7, 1, 25, 400, 41, 0.41)


def test_chance_matches_do_not_hide_a_stretch():
    item = np.arange(1, 101)
    text = [1, 0, 0, 0, 5, 0, 0, 0, 9, 0, 0, 0, *[0 if k % 4 == 1 else k for k in range(12, 54)]]
    span, matched = L.longest_stretch(item, np.array(text), L.Rule())
    assert span >= 40 and matched >= 0.75 * span


def test_short_items(spark):
    docs = [(1, "u v"), (2, "u x v"), (3, "u x"), (4, "v u"), (5, "p q x r s"), (6, "p q x")]
    assert leaks(spark, docs, [(1, "u v"), (2, "p q r s t u")]) == {(1, 1), (2, 1), (5, 2)}


def test_candidates_hold_every_stretch():
    rnd = random.Random(16)
    pairs = 0
    for rule in L.RULES * 40:
        items = [(k, " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 25)))) for k in range(4)]
        index = L.ItemIndex(items)
        docs = [np.array([index.vocabulary.get(rnd.choice("abcdefghijxyz"), 0) for _ in range(rnd.randrange(0, 40))], np.int32) for _ in range(5)]
        start = np.concatenate([[0], np.cumsum([len(c) + 1 for c in docs])])
        codes = np.concatenate([x for c in docs for x in (c, [0])]).astype(np.int32)
        got = {(d, i) for d, i, _ in L.candidates(codes, start, index, (rule,))}
        for d, c in enumerate(docs):
            for i, item in enumerate(index.codes):
                span, _ = L.longest_stretch(item, c, rule)
                if span:
                    pairs += 1
                    assert (d, i) in got
    assert pairs > 50


def test_every_second_or_third_word_replaced(spark):
    rnd = random.Random(18)
    item = [f"i{k}" for k in range(60)]
    around = lambda t: " ".join([*sentence(rnd, 60), *t, *sentence(rnd, 60)])
    broken = lambda m, n: [w if k % m else f"z{k}" for k, w in enumerate(item)][:n]
    docs = [(1, around(broken(2, 60))), (2, around(broken(3, 60))), (3, around(broken(3, 46))), (20, around(broken(2, 40)))]
    assert leaks(spark, docs, [(1, " ".join(item))]) == {(1, 1), (2, 1), (3, 1)}


def test_scripts_without_blanks(spark):
    ja, zh, th = "東京都は日本の首都であり、世界最大の都市圏を形成している。", "长江是亚洲第一长河，全长六千余公里", "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"
    docs = [
        (1, "さて、ここで言うと" + ja[:-1] + "のです。終わり。"), (2, "また日本の首都であり世界最大の、なのです。"), (3, "有人说" + zh.replace("，", "") + "左右。"),
        (4, "ว่า" + th + "ครับ"), (5, "GDPは" + "\n".join(ja)), (20, "大阪は日本の都市である。これは首都ではない。"), (21, "黄河是亚洲的河"), (22, "เมืองไทย"),
    ]
    assert leaks(spark, docs, [(1, ja), (2, zh), (3, th), (4, "水")]) == {(1, 1), (2, 1), (3, 2), (4, 3), (5, 1)}
    assert L.words_of("AはB 東京、都 x") == ["a", "は", "b", "東京", "京都", "x"]


def test_common_words():
    rnd = random.Random(19)
    for _ in range(200):
        a, b = ([rnd.randrange(1, 7) for _ in range(rnd.randrange(0, 14))] for _ in range(2))
        b = [x if rnd.random() < 0.8 else 0 for x in b]
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        assert L.common_words(np.array(a, int), np.array(b, int)) == row[-1]


def test_items_in_blocks_and_small_shards(spark, monkeypatch):
    rnd = random.Random(9)
    items = [(k, " ".join(sentence(rnd, 50))) for k in range(12)]
    docs = [(100 + k, " ".join(sentence(rnd, 30)) + " " + items[k % 12][1] + " " + " ".join(sentence(rnd, 200))) for k in range(30)]
    want = {(100 + k, k % 12) for k in range(30)}
    assert leaks(spark, docs, items) == want
    monkeypatch.setattr(L, "ITEM_BLOCK_BYTES", 700)
    monkeypatch.setattr(L, "WORDS_AT_ONCE", 100)
    assert leaks(spark, docs, items) == want


def test_empty_sides(spark):
    assert leaks(spark, [], [(1, "a b c d")]) == set()
    assert leaks(spark, [(1, "a b c d")], []) == set()
    assert leaks(spark, [(1, "a b c d")], [(1, "... !")]) == set()


def test_suffix_array_and_search_against_brute_force():
    rnd = np.random.default_rng(6)
    for alphabet, n in ((3, 60), (40, 400), (2, 200)):
        codes = rnd.integers(0, alphabet, n).astype(np.int32)
        padded = np.concatenate([codes, np.zeros(20, np.int32)])
        sa = L.suffix_array(padded, 16)
        key = lambda p: tuple(padded[p : p + 16].tolist())

        def cut(t):  # a 0 ends a comparison
            return t[: t.index(0)] if 0 in t else t

        assert sorted(sa.tolist()) == np.flatnonzero(codes).tolist()
        keys = [cut(key(p)) for p in sa]
        assert keys == sorted(keys)


def test_longest_verbatim_matches():
    rnd = random.Random(10)
    vocabulary = [f"v{k}" for k in range(6)]
    index = L.ItemIndex([(k, " ".join(rnd.choice(vocabulary) for _ in range(15))) for k in range(4)])
    text = [rnd.choice([*vocabulary, "other"]) for _ in range(300)]
    codes = np.array([*[index.vocabulary.get(w, 0) for w in text], 0], np.int32)
    sa = L.suffix_array(codes, 16)
    query = np.flatnonzero(index.flat)
    for low, high in ((0, len(sa)), (5, 90), (7, 7)):
        length, place = L.verbatim_matches(codes, sa, index.flat, query, np.full(len(query), low), np.full(len(query), high))
        for q, n, p in zip(query, length, place):
            def common(at):
                k = 0
                while index.flat[q + k] and index.flat[q + k] == codes[at + k]:
                    k += 1
                return k

            assert n == max((common(at) for at in sa[low:high]), default=0)
            assert n == 0 or common(p) == n


def test_very_long_texts_and_items(spark):
    rnd = random.Random(14)
    many = [f"x{rnd.randrange(3000)}" for _ in range(12_000)]
    text = [f"y{rnd.randrange(3000)}" for _ in range(150_000)]
    docs = [(1, " ".join(text)), (2, " ".join([*text[:90_000], *many[2000:9000], *text[90_000:]])), (3, " ".join(many[:1500]))]
    assert leaks(spark, docs, [(7, " ".join(many)), (8, "a b c")]) == {(2, 7)}


def test_affected_documents_are_removed(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    hit = spark.createDataFrame([(1, 7), (1, 8)], "doc_id long, item_id long")
    assert sorted(r.text for r in L.without_leaks(d, "doc_id", hit).collect()) == ["b", "c"]
