"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import base64
import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import ann, decontam, langid, mixing, neardup, pii, sharding, tokencount, toxicity, warc
from foliant.llm.shared import hashed_words
from tests.llm import nasty


# ---- token counts


def naive_tokens(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return len(parts)
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_equal_naive_merging():
    r = random.Random(3)
    for _ in range(60):
        ranks, pieces = {}, [b"a", b"b", b"c"]
        for k in range(25):
            p = r.choice(pieces) + r.choice(pieces)
            if p not in ranks:
                ranks[p] = k
                pieces.append(p)
        for _ in range(20):
            w = bytes(r.choice(b"abc") for _ in range(r.randint(0, 40)))
            assert len(w) - tokencount.merges(w, ranks) == naive_tokens(w, ranks)


def test_counts_equal_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokencount.read_ranks(tokencount.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [nasty.prose(k, 80) for k in range(20)] + ["naïve café <|endoftext|> 東京 🙂🙂", "a" * 3000, " " * 50 + "x", "it's we'll\r\n\t12345"]
    got = tokencount.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").collect()
    assert {r.doc_id: r.tokens for r in got} == {i: len(own.encode_ordinary(t)) for i, t in enumerate(texts)}


# ---- near duplicates


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    texts = {}
    for k in range(60):
        words = nasty.prose(100 + k, r.randint(30, 200)).split()
        texts[len(texts)] = " ".join(words)
        for _ in range(r.choice([0, 0, 1, 3])):
            edited = [w if r.random() > 0.04 else f"e{r.randint(0, 10**6)}" for w in words]
            texts[len(texts)] = " ".join(edited)
    crowd = nasty.prose(7, 150).split()
    for k in range(150):
        texts[len(texts)] = " ".join(w if r.random() > 0.02 else f"c{k}" for w in crowd)
    got = {x.doc_id: x.group_id for x in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    sets = {}
    for i, t in texts.items():
        sets[i] = set(neardup.shingles(*hashed_words([t]))[0].tolist())
    alike = [(i, j) for i, j in itertools.combinations(texts, 2) if jaccard(sets[i], sets[j]) >= 0.62]
    assert len(alike) > 1000
    assert sum(got.get(i, -1) == got.get(j, -2) for i, j in alike) >= 0.99 * len(alike)
    for i, g in got.items():  # nobody joins a group without resembling a member
        assert any(jaccard(sets[i], sets[j]) >= 0.4 for j, h in got.items() if h == g and j != i)


def test_links_in_crowded_regions(spark, monkeypatch):
    """A~B, B~C and A~C under the threshold: the links are the same among 20 or 80 others of their region, and with regions split."""
    r = random.Random(21)
    base = [f"w{k}" for k in range(120)]
    b = base[:]
    a = base[22:] + [f"a{k}" for k in range(22)]
    c = [f"c{k}" for k in range(22)] + base[:-22]

    def crowd(n):
        return [(10 + k, " ".join(w if r.random() > 0.02 else f"x{k}y{i}" for i, w in enumerate(base)) + f" t{k}") for k in range(n)]

    for n, small in ((20, 1024), (80, 1024), (80, 8)):
        monkeypatch.setattr(neardup, "SMALL", small)
        rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), *crowd(n)]
        sets = {i: set(neardup.shingles(*hashed_words([t]))[0].tolist()) for i, t in rows}
        want = {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if jaccard(sets[i], sets[j]) >= neardup.THRESHOLD}
        assert (1, 2) in want and (2, 3) in want and (1, 3) not in want
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {x.doc_id: x for x in neardup.near_duplicates(df).collect()}
        assert {x.group_id for x in got.values()} == {1} and set(got) == set(sets)
        degree = {i: sum(i in p for p in want) for i in sets}
        assert all(got[i].links <= degree[i] for i in sets)
        if small > n:
            assert sum(x.links for x in got.values()) >= 0.98 * sum(degree.values())
            assert got[1].links >= 0.95 * degree[1] and got[3].links >= 0.95 * degree[3]
        else:  # regions split at every depth, to the last
            assert all(x.links for x in got.values())


def test_documents_with_one_shared_passage_all_stay(spark):
    shared = nasty.prose(77, 60)
    r = random.Random(3)
    texts = [(k, shared + " " + " ".join(f"d{k}n{r.randint(0, 10**9)}" for _ in range(42))) for k in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert neardup.near_duplicates(docs).collect() == []
    assert neardup.drop_near_duplicates(docs).count() == 600


def test_pairs_near_the_threshold_are_found(spark):
    r = random.Random(13)
    texts, pairs = [], []
    for k in range(400):
        words = [f"p{k}n{i}" for i in range(102)]
        edge = r.randint(28, 34)  # similarity 0.5 to 0.58
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[edge:] + [f"q{k}n{i}" for i in range(edge)]))]
    sets = {i: set(neardup.shingles(*hashed_words([t]))[0].tolist()) for i, t in texts}
    pairs = [(2 * k, 2 * k + 1) for k in range(400) if jaccard(sets[2 * k], sets[2 * k + 1]) >= neardup.THRESHOLD]
    got = {x.doc_id: x.group_id for x in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(pairs) > 300
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs) >= 0.9 * len(pairs)
    for i, g in got.items():
        assert any(jaccard(sets[i], sets[j]) >= neardup.THRESHOLD for j, h in got.items() if h == g and j != i)


def test_no_link_is_left_out(spark, monkeypatch):
    """Pairs at the threshold, which the orders miss by chance, and a crowd whose regions are cut into blocks or go deeper: links are those of brute force."""
    r = random.Random(31)
    rows = []
    for k in range(150):
        words = [f"p{k}n{i}" for i in range(102)]
        edge = r.randint(30, 35)  # similarity 0.48 to 0.55
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[edge:] + [f"q{k}n{i}" for i in range(edge)]))]
    base = [f"w{k}" for k in range(120)]
    for k in range(70):
        share = r.choice((0.02, 0.06, 0.1))
        rows.append((1000 + k, " ".join(w if r.random() > share else f"x{k}y{i}" for i, w in enumerate(base)) + f" t{k}"))
    sets = {i: set(neardup.shingles(*hashed_words([t]))[0].tolist()) for i, t in rows}
    want = [p for p in itertools.combinations(sets, 2) if jaccard(sets[p[0]], sets[p[1]]) >= neardup.THRESHOLD]
    degree = collections.Counter(itertools.chain.from_iterable(want))
    assert sum(a < 1000 for a, _ in want) > 60 and sum(a >= 1000 for a, _ in want) > 500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small, many in ((1024, 32), (8, 32), (4, 1)):
        monkeypatch.setattr(neardup, "SMALL", small)
        monkeypatch.setattr(neardup, "MANY", many, raising=False)
        got = {x.doc_id: x for x in neardup.near_duplicates(df).collect()}
        assert {i: x.links for i, x in got.items() if x.links != degree[i]} == {} and set(got) == set(degree)
        assert all(got[a].group_id == got[b].group_id for a, b in want)


def test_likeness_estimates_jaccard():
    r = random.Random(9)
    words = [f"w{r.randint(0, 10**9)}" for _ in range(400)]
    for share in (0.0, 0.02, 0.1, 0.5):
        other = [w if r.random() > share else f"x{r.randint(0, 10**9)}" for w in words]
        sig = neardup.signatures(*hashed_words([" ".join(words), " ".join(other)])).astype(np.uint8)
        sets = [set(neardup.shingles(*hashed_words([" ".join(x)]))[0].tolist()) for x in (words, other)]
        assert abs(neardup.likeness(sig[0], sig[1]) - jaccard(*sets)) < 0.16


def test_components(spark):
    from foliant.llm.shared import Scratch

    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (150, 200), (300, 301)]
    got = neardup.components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark)).collect()
    assert {r.node: r.label for r in got} == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}


# ---- decontamination


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_by_bits():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(1, 6) for _ in range(r.randint(1, 70))] for _ in range(2))
        assert decontam.Item(0, np.array(a, np.uint16), np.ones(decontam.TERMS)).common(b) == naive_lcs(a, b)


def test_leaks_and_paraphrases(spark):
    r = random.Random(2)
    items = {k: nasty.prose(500 + k, n) for k, n in enumerate([12, 16, 25, 40, 64, 90, 150])}
    docs, truth = {}, set()
    for k in range(120):
        docs[k] = nasty.prose(1000 + k, r.randint(0, 300))
    for i, t in items.items():
        words = t.split()
        light = [w if r.random() > 0.12 else f"z{r.randint(0, 999)}" for w in words]
        for j, w in enumerate((words, light)):
            host = docs[i * 10 + j].split()
            at = r.randint(0, len(host))
            docs[i * 10 + j] = " ".join(host[:at] + w + host[at:])
            truth.add((i * 10 + j, i))
    docs[110] += " " + " ".join(items[3].split()[:10])  # a quarter of an item is no leak
    got = decontam.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == truth


def test_leaks_whose_content_words_are_replaced(spark):
    """Equals a brute-force join of all stretches of documents with all items, also of more than one lane."""
    r = random.Random(4)
    ordinary = sorted({nasty.prose(9000 + k, 1) for k in range(400)})

    def text(n, name):
        return [f"{name}x{i}" if r.random() < 0.25 else r.choice(ordinary) for i in range(n)]

    items = {k: text(n, f"i{k}") for k, n in enumerate([16, 24, 40, 40, 64, 65, 150])}
    docs = {k: text(r.randint(0, 250), f"d{k}") for k in range(300)}
    truth = set()
    for k, words in items.items():
        changed = [f"new{i}" if "x" in w else w for i, w in enumerate(words)]
        kept = sum(a == b for a, b in zip(words, changed))
        changed = [b if kept >= 0.7 * len(words) or i % 3 else a for i, (a, b) in enumerate(zip(words, changed))]
        at = r.randint(0, len(docs[k]))
        docs[k] = docs[k][:at] + changed + docs[k][at:]
        truth.add((k, k))
    w = np.ones(decontam.TERMS, np.float32)
    hashed = {k: decontam.terms_of([" ".join(x)])[0] for k, x in docs.items()}
    brute = set()
    for j, x in items.items():
        item = decontam.Item(j, decontam.terms_of([" ".join(x)])[0], w)
        for k, ids in hashed.items():
            for at in range(0, max(1, len(ids) - 2 * item.n + 1)):
                if item.common(ids[at : at + 2 * item.n].tolist()) >= decontam.VERBATIM * item.n:
                    brute.add((k, j))
                    break
    assert truth == brute
    got = decontam.leaks(spark.createDataFrame([(k, " ".join(x)) for k, x in docs.items()], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == brute


def test_latent_vectors_keep_angles():
    """With fewer passages than the rank, the map keeps the cosines of the weighted passages."""
    r = np.random.default_rng(0)
    w = np.zeros(decontam.TERMS, np.float32)
    w[1:400] = r.random(399) + 0.5
    passages = [r.integers(1, 400, 40) for _ in range(30)]
    a = np.zeros((30, decontam.TERMS), np.float32)
    for i, p in enumerate(passages):
        np.add.at(a[i], p, w[p])
    a = decontam.unit(a)
    latent = decontam.latent_map(a.T @ (a @ decontam.gaussian(decontam.TERMS)), w)
    x = decontam.unit(np.stack([latent[p].sum(0) for p in passages]))
    assert np.abs(x @ x.T - a @ a.T).max() < 1e-2


def test_leaks_in_scripts_without_spaces_and_of_few_words(spark):
    r = random.Random(6)
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n))
    items = {0: han(60), 1: han(60), 2: han(60), 10: "quorvex", 11: "zimble quor", 12: "vax brim, Toll keg", 13: "of of of of"}
    docs = {k: han(80) + items[k] + "。" + han(40) for k in range(3)}
    docs |= {3: han(300), 4: nasty.prose(1, 50) + " Quorvex! " + nasty.prose(2, 9), 5: "a zimble  quor", 6: "quor zimble of of of", 7: "x VAX brim toll keg y", 8: "vax brim keg toll", 9: "vax brim toll"}
    got = decontam.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(0, 0), (1, 1), (2, 2), (4, 10), (5, 11), (7, 12)}


def test_slices_of_the_benchmark_change_nothing(spark, monkeypatch):
    items = [(k, nasty.prose(700 + k, 20)) for k in range(7)]
    docs = spark.createDataFrame([(k, nasty.prose(k, 60) + " " + items[k % 7][1]) for k in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(x)[:2] for x in decontam.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontam, "SLICE", 2)
    assert {tuple(x)[:2] for x in decontam.leaks(docs, bench).collect()} == whole == {(k, k % 7) for k in range(30)}


# ---- nearest neighbours


def test_tally_counts():
    r = np.random.default_rng(1)
    sets = r.random((ann.LINES, 3, 128)) < 0.7
    tally = ann.Tally((3, 2))
    for k, x in enumerate(sets):
        tally.add(np.packbits(x, axis=1, bitorder="little").view(np.uint64))
        if k == 20:
            tally.settle()
    tally.settle()
    n = sets.sum(0)
    for least in (1, 40, 45, 47, 60, 64):
        got = np.unpackbits(tally.at_least(least).view(np.uint8), axis=1, bitorder="little")
        assert (got == (n >= least)).all()


def test_queries_are_a_stated_set_against_all_rows(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(-100, 101)], "vec_id long, embedding array<double>")
    few, whole = ({x.vec_id: x for x in ann.neighbours(df, every=n).collect()} for n in (50, 1))
    assert set(few) == {-100, -50, 0, 50, 100} and len(whole) == 201
    assert all(few[i] == whole[i] for i in few)


@pytest.mark.parametrize("blocks", [(10_000, 10_000), (300, 200)])
def test_recall(spark, blocks):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 32))
    x[:200] = x[0] + 0.05 * r.normal(size=(200, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {z.vec_id: z for z in ann.neighbours(df, data_block=blocks[0], query_block=blocks[1]).collect()}
    d = np.linalg.norm(x[:, None].astype(float) - x[None].astype(float), axis=2)
    np.fill_diagonal(d, 9)
    kth = np.sort(d, 1)[:, ann.K - 1]
    hits = sum((d[i, got[i].neighbours] <= kth[i] + 1e-9).sum() for i in range(900))
    assert len(got) == 900 and hits / (900 * ann.K) >= 0.95
    assert all(np.allclose(z.distances, d[z.vec_id, z.neighbours], atol=1e-6) and z.distances == sorted(z.distances) for z in got.values())


# ---- personal identifiers


def test_bootstrapping_finds_what_no_check_knows(spark):
    r = random.Random(8)

    def digits(n):
        return "".join(str(r.randint(0, 9)) for _ in range(n))

    rows, hidden, clean = [], set(), set()
    for k in range(300):
        text = nasty.prose(k, 30)
        kind = k % 5
        if kind == 0:
            number = digits(16)
            rows.append((k, f"{text} {number} {text}"))
            if not pii.luhn(number):
                hidden.add(k)
        elif kind == 1:
            rows.append((k, f"{text} ana{k}@mail.example.org, {text}"))
        elif kind == 2:
            rows.append((k, f"{text} version {r.randint(1, 9)}.{r.randint(0, 9)} and {r.randint(1, 99)}. {text}"))
            clean.add(k)
        elif kind == 3:
            rows.append((k, f"{text} member no: Q{digits(7)} {text}" if k % 15 == 3 else f"{text} member no: {digits(3)}-{digits(2)}-{digits(4)} {text}"))
        else:
            rows.append((k, text))
            clean.add(k)
    got = pii.identifiers(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {x.doc_id for x in got}
    # a tenth of random numbers pass the check; their form alone isn't trusted then, whereas that of cards mostly valid is
    assert hidden and not found & hidden
    assert not found & clean
    assert {k for k, _ in rows if k % 5 in (1, 3)} <= found
    # no check knows these; the words around them do
    assert {x.doc_id for x in got if not x.seed} == {k for k, _ in rows if k % 15 == 3}
    assert all(x.value[0] == "Q" and x.type == "national_id" for x in got if not x.seed)
    cards = []
    for k in range(200):
        n = digits(15)
        n = next(n + str(c) for c in range(10) if pii.luhn(n + str(c))) if k % 4 else n + "0"
        cards.append((k, f"{nasty.prose(k, 20)} {n} {nasty.prose(k + 1, 20)}"))
    got = pii.identifiers(spark.createDataFrame(cards, "doc_id long, text string")).collect()
    assert {x.doc_id for x in got} == set(range(200)) and any(not x.seed for x in got)
    for x in got:
        assert dict(cards)[x.doc_id][x.start : x.end] == x.value


@pytest.mark.parametrize("value, kind", [("a.b+c@x.example.co", "email"), ("203.0.113.9", "ip"), ("999.1.1.1", None), ("+1 (456) 555-2186", "phone"), ("4111111111111111", "card"), ("4111111111111112", None), ("078-05-1120", "national_id"), ("GB82WEST12345698765432", "iban"), ("2.0", None)])
def test_seeds(value, kind):
    assert pii.seed_type(value, "") == kind


def test_instances_are_cut_well():
    text = 'call +1 (456) 555-2186, mail <x.y@z.example.com>. password=ab12cd34ef56gh token = "0123456789abcdef" (see 4.0).'
    assert [(v, label) for _, _, v, label, _ in pii.instances(text)] == [("+1 (456) 555-2186", ""), ("x.y@z.example.com", ""), ("ab12cd34ef56gh", "password"), ("0123456789abcdef", "token"), ("4.0", "")]


def test_identifiers_in_runs_without_white_space(spark):
    mails = [f"ana{k}@mail.example.org" for k in range(400)]
    texts = [",".join(mails), "{" + ",".join(f'"email":"{m}"' for m in mails) + "}", "/q?" + "&".join(f"email={m}" for m in mails), "a@b.example.com,c@d.example.com;4111111111111111", "f(e@f.example.com)(415)555-2671 x-1=g@h.example.com"]
    assert len(texts[1]) > 10_000
    got = pii.identifiers(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {(x.doc_id, x.value) for x in got}
    assert {(k, m) for k in range(3) for m in mails} | {(3, "a@b.example.com"), (3, "c@d.example.com"), (3, "4111111111111111")} | {(4, "e@f.example.com"), (4, "g@h.example.com")} <= found
    for x in got:
        assert texts[x.doc_id][x.start : x.end] == x.value


def test_identifiers_in_long_strings_and_scripts_without_spaces(spark):
    mini = '{"a":' + '"x"' + ',"pad":"' + "p" * 120 + '","mail":"ana.b@mail.example.com","tel":"415-555-2671","more":"' + "q" * 90 + '"}'
    solid = "x" * 300 + "/ana.c@mail.example.com/" + "y" * 300 + ":4111111111111111/" + "z" * 300
    texts = [mini, "联系我ana.d@mail.example.com谢谢，卡4111111111111111。", solid, "k" * 3_000_000 + "@" + "k" * 1_000_000 + " ana.e@mail.example.com"]
    got = pii.identifiers(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {(x.doc_id, x.value) for x in got}
    assert {(0, "ana.b@mail.example.com"), (0, "415-555-2671"), (1, "ana.d@mail.example.com"), (1, "4111111111111111"), (2, "ana.c@mail.example.com"), (2, "4111111111111111"), (3, "ana.e@mail.example.com")} <= found
    assert all(texts[x.doc_id][x.start : x.end] == x.value for x in got)


def test_letters_in_a_trusted_slot(spark):
    """Where most of what follows a label passes a check, the rest of it is found too, though it holds letters only."""
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefghkmnpq") for _ in range(n))
    rows = [(k, f"{nasty.prose(k, 20)} password: {word(10)}{'' if k % 4 == 0 else '42x'} {nasty.prose(k + 1, 9)}. note: {word(6)} end") for k in range(120)]
    got = pii.identifiers(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in got if not x.seed} == {k for k, _ in rows if k % 4 == 0}  # recall 1 of letter-only secrets
    assert len(got) == 120 and {x.type for x in got} == {"secret"}


def test_scratch_holds_the_result_only(spark):
    from pathlib import Path

    got = pii.identifiers(spark.createDataFrame([(1, "ana.b@mail.example.com")], "doc_id long, text string"))
    folder = Path(got.inputFiles()[0].removeprefix("file://")).parent.parent
    assert [p.name.split("-", 1)[1] for p in folder.iterdir()] == ["identifiers"]


# ---- language


def test_languages_held_out(spark):
    r = random.Random(6)
    alphabets = {"xx": "aeioulmn", "yy": "aeustrkp", "zz": "oiugbdvz", "ww": "äöüaehsc"}

    def text(lang, n):
        return " ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randint(2, 7))) for _ in range(n))

    rows = [(i, text(lang, r.randint(8, 40)), lang) for i in range(600) for lang in [r.choice(list(alphabets))]]
    docs = spark.createDataFrame(rows[:400], "doc_id long, text string, lang string")
    model = langid.train(*langid.training_rows(docs, langid.Fit(per_language=60)), langid.Fit(per_language=60))
    test = spark.createDataFrame([(i, t) for i, t, _ in rows[400:]] + [(999, text("xx", 20) + " " + text("zz", 20))], "doc_id long, text string")
    got = {x.doc_id: x for x in langid.identify(test, model).collect()}
    assert sum(got[i].language == lang for i, _, lang in rows[400:]) >= 0.97 * 200
    assert got[999].ambiguous and sum(got[i].ambiguous for i, _, _ in rows[400:]) < 40


def test_one_language_and_none(spark):
    docs = spark.createDataFrame([(i, nasty.prose(i, 9), "en") for i in range(5)], "doc_id long, text string, lang string")
    fit = langid.Fit()
    assert {x.language for x in langid.identify(docs, langid.train(*langid.training_rows(docs, fit), fit)).collect()} == {"en"}
    nameless = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(x.language, x.ambiguous) for x in langid.identify(nameless, langid.train(*langid.training_rows(nameless, fit), fit)).collect()} == {(None, True)}


def test_codewords_are_apart():
    code = langid.codewords(8, 15, 1)
    assert min(int((a != b).sum()) for a, b in itertools.combinations(code, 2)) >= 4
    assert all(0 < (c > 0).sum() < 8 for c in code.T)


def test_counts_in_pieces(monkeypatch):
    texts = ["hello wörld " * 50, "abc", "x" * 49, nasty.prose(1, 300)]
    whole = langid.counts(texts)
    monkeypatch.setattr(langid, "SPAN", 37)
    assert (langid.counts(texts) == whole).all()


# ---- toxicity


def test_toxicity_held_out(spark):
    r = random.Random(12)
    bad = [f"grob{x}" for x in ("ian", "heit", "ling", "er", "sam")]

    def doc(i):
        words = nasty.prose(i, r.randint(20, 300)).split()
        toxic = r.random() < 0.3
        for _ in range(r.randint(1, 4) if toxic else 0):
            words.insert(r.randint(0, len(words)), r.choice(bad))
        return i, " ".join(words), r.choice(["en", "de"]), int(toxic)

    rows = [doc(i) for i in range(900)]
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i < 600], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, labels).collect()}
    test = rows[600:]
    assert sum(got[i].toxic == bool(y) for i, _, _, y in test) >= 0.97 * len(test)
    kept = {x.doc_id for x in toxicity.reject_toxic(docs, labels).collect()}
    assert kept == {i for i, x in got.items() if not x.toxic}


def test_scorer_equals_model(monkeypatch):
    r = np.random.default_rng(0)
    fit = toxicity.Fit(buckets=512)
    model = toxicity.Model(fit, r.normal(size=512).astype(np.float32))
    texts = [nasty.prose(k, n) for k, n in enumerate([1, 2, 3, 50, 700])]
    rows = [np.array([toxicity.parts(w, 512) for w in t.split()], np.int32) for t in texts]
    want = model.scores(rows)
    scorer = toxicity.Scorer(model)
    chance = lambda x: 1 / (1 + np.exp(-x))
    assert np.allclose(chance(scorer(texts)), want, atol=1e-5)
    long = " ".join(texts[4] for _ in range(60))  # more than one span
    assert np.allclose(chance(scorer([long]))[0], model.scores([np.concatenate([rows[4]] * 60)])[0], atol=1e-5)


def test_thresholds_equal_brute_force(spark):
    """The best F1 over all labelled rows that weren't learnt from, each class weighing what it weighs among all."""
    r = np.random.default_rng(5)
    fit = toxicity.Fit()
    model = toxicity.Model(fit, np.zeros(fit.buckets))
    model.seen = list(range(0, 1000, 3))
    y = r.random(1000) < 0.2
    z = np.where(y, r.normal(1.5, 1.5, 1000), r.normal(-1.5, 1.5, 1000))
    lang = ["en" if k % 2 else "de" for k in range(1000)]
    odds = spark.createDataFrame([(k, lang[k], float(z[k])) for k in range(1000)], "doc_id long, lang string, odds double")
    got = toxicity.thresholds(odds, spark.createDataFrame([(k, int(y[k])) for k in range(1000)], "doc_id long, toxic int"), model, fit)
    assert set(got) == {"en", "de", None}
    for name in ("en", "de"):
        own = np.array([x == name for x in lang])
        free = own & ~np.isin(np.arange(1000), model.seen)
        weight = np.where(y, (own & y).sum() / (free & y).sum(), (own & ~y).sum() / (free & ~y).sum())

        def f1(t):
            over = free & (z >= t)
            return 2 * weight[over & y].sum() / (weight[over].sum() + weight[free & y].sum())

        assert f1(got[name]) >= max(f1(t) for t in z[free]) - 0.01


def test_model_does_not_depend_on_the_order_of_repeated_ids(spark):
    rows = [(k % 40, nasty.prose(k, 30) + (" grobian" if k % 3 == 0 else ""), "en") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (toxicity.fit_model(d, labels) for d in (docs, docs.orderBy(F.desc("text")).repartition(7)))
    assert all((x == y).all() for x, y in zip(a.arrays(), b.arrays()))


# ---- mixing and sharding


def test_mixing_equals_sorting(spark):
    r = random.Random(3)
    rows = [(i if i % 50 else 7, nasty.prose(i, r.randint(0, 30)), r.choice(["a", "a", "a", "b", None])) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 1.0, "b": 2.0, None: 0.5}
    shares = (0.1, 0.3, 0.9)
    got = []
    for share in shares:
        got.append(sorted(map(repr, mixing.mix(docs, share, weights).collect())))
    h = {i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], 16) for i, _, _ in rows}
    total = sum(len(t.split()) for _, t, _ in rows)
    for share, have in zip(shares, got):
        want = []
        for s, w in weights.items():
            budget, run = int(share * total * (w / 3.5)), 0
            own = sorted((x for x in rows if x[2] == s), key=lambda x: h[x[0]])
            for key, same in itertools.groupby(own, key=lambda x: h[x[0]]):
                same = list(same)
                run += sum(len(t.split()) for _, t, _ in same)
                if run > budget:
                    break
                want += same
        assert have == sorted(repr(tuple(x)) if False else f"Row(doc_id={x[0]!r}, text={x[1]!r}, source={x[2]!r})" for x in want)
    assert set(got[0]) <= set(got[1]) <= set(got[2])


def naive_shards(rows, hashes, shards, seed):
    out = []
    for s in range(shards):
        bucket = sorted((x for x in zip(rows, hashes) if x[1] % shards == s), key=lambda x: (x[0][0], x[1]))
        pick = np.random.default_rng([seed, s]).random(len(bucket))
        for i in range(len(bucket) - 1, 0, -1):
            j = int(pick[i] * (i + 1))
            bucket[i], bucket[j] = bucket[j], bucket[i]
        out += [(s, p, x[0]) for p, (x, _) in enumerate(bucket)]
    return out


def test_sharding_equals_fisher_yates(spark):
    rows = [(i, nasty.prose(i, 20)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = sharding.record_bytes(docs)
    assert size == sum(len(t) + 64 for _, t in rows)
    out = sharding.shuffle(docs, bucket_bytes=size // 7)
    hashes = [x[0] for x in docs.select(sharding.record_hash(docs, sharding.SEED)).collect()]
    got = sorted((x.shard, x.position, x.doc_id) for x in out.collect())
    assert got == naive_shards(rows, hashes, 8, sharding.SEED)
    again = sharding.shuffle(docs.repartition(7).orderBy(F.desc("doc_id")), bucket_bytes=size // 7)
    assert sorted((x.shard, x.position, x.doc_id) for x in again.collect()) == got
    assert [x[2] for x in got] != sorted(x[2] for x in got)
    several = sharding.shuffle(docs, bucket_bytes=size // 7, parts=3)  # shards share partitions
    assert several.rdd.getNumPartitions() == 3
    assert sorted((x.shard, x.position, x.doc_id) for x in several.collect()) == got


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, nasty.prose(i, 20)) for i in range(500)], "doc_id long, text string")
    back = sharding.write_shards(docs, str(tmp_path / "shards"), bucket_bytes=sharding.record_bytes(docs) // 5)
    assert sorted(map(repr, back.select("doc_id", "text").collect())) == sorted(map(repr, docs.collect()))
    files = back.select("shard", F.input_file_name().alias("f")).distinct().collect()
    assert len(files) == len({x.f for x in files}) == len({x.shard for x in files}) > 3  # one file a shard
    assert all([r.position for r in spark.read.parquet(x.f).collect()] == list(range(back.filter(F.col("shard") == x.shard).count())) for x in files[:2])


def test_sharding_counts_and_hashes_nested_values(spark):
    docs = spark.createDataFrame([(i, [1000 + i] * 1000, {"a": {"b": i}}, (i, {"k": i}), "x") for i in range(40)], "doc_id long, v array<int>, m map<string,map<string,int>>, s struct<n:int,m:map<string,int>>, __record_hash__ string")
    assert sharding.record_bytes(docs) > 40 * 4000
    out = sharding.shuffle(docs, bucket_bytes=40_000)
    assert out.columns == [*docs.columns, "shard", "position"] and out.select("shard").distinct().count() > 2
    assert sorted(map(repr, out.drop("shard", "position").collect())) == sorted(map(repr, docs.collect()))


def test_permutation_is_uniform():
    seen = np.zeros((4, 4))
    for shard in range(4000):
        for place, x in enumerate(sharding.fisher_yates(4, 1, shard)):
            seen[place, x] += 1
    assert np.abs(seen / 4000 - 0.25).max() < 0.03


# ---- files


def test_foreign_records():
    body = "<p>päge</p>".encode()
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    head = lambda *more: ("\r\n".join(["WARC/1.1", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:x>", "content-type: application/http; msgtype=response", "WARC-Target-URI: <http://a/>", *more, f"Content-Length: {len(http)}"]) + "\r\n\r\n").encode()
    want = (None, "http://a/", "<p>päge</p>", hashlib.md5(body).hexdigest())
    for more in ((), (f"WARC-Payload-Digest: sha1:{sha}",), (f"WARC-Payload-Digest: sha-256:{hashlib.sha256(body).hexdigest()}",), ("WARC-Payload-Digest: blake3:zz",)):
        assert warc.parsed(head(*more) + http + b"\r\n\r\n") == want
    with pytest.raises(ValueError):
        warc.parsed(head(f"WARC-Payload-Digest: sha1:{'A' * 32}") + http)
    assert warc.parsed(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 1\r\n\r\nx") is None
    assert b"WARC-Record-ID: <urn:uuid:" in warc.record(1, "u", "x", "f/0") != warc.record(1, "u", "x", "f/1")


def test_selections_skip_records_and_spread_reads(spark, monkeypatch):
    from foliant.llm.shared import Scratch, shared_folder

    pages = [(i, f"http://h/{i}", nasty.prose(i, 200)) for i in range(400)]
    scratch, folder = Scratch(spark), shared_folder(spark)
    written = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), folder, scratch)
    again = warc.index(written.select("file").distinct(), folder, scratch)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, written.collect()))
    monkeypatch.setattr(warc, "LEAST_BLOCK", 1 << 14)
    monkeypatch.setattr(warc, "GAP", 256)
    some = warc.read(written.filter("page_id % 7 = 3"), folder)
    assert sorted(map(tuple, some.select("page_id", "url", "html").collect())) == [p for p in pages if p[0] % 7 == 3]
    assert some.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() > 1  # of one file


def test_ranges_are_coalesced_and_bounded():
    rows = [("f", 0, 10), ("f", 10, 5), ("f", 15 + warc.GAP, 7), ("f", 10 * warc.LARGEST, warc.LARGEST + 9), ("g", 0, 3)]
    got = list(warc.ranges(rows))
    assert [(f, a, b, len(x)) for f, a, b, x in got] == [("f", 0, 22 + warc.GAP, 3), ("f", 10 * warc.LARGEST, 11 * warc.LARGEST + 9, 1), ("g", 0, 3, 1)]


def test_damaged_records_are_noticed():
    raw = warc.record(1, "http://a/", "<p>body</p>")
    assert warc.parsed(raw)[:3] == (1, "http://a/", "<p>body</p>")
    with pytest.raises(ValueError):
        warc.parsed(raw.replace(b"body", b"bodx"))
    assert base64.b64encode(" é".encode()) in warc.record(None, " é", None)
