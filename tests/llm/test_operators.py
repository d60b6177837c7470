"""The ten operators on small tables: brute force, and nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidepool.llm import bpe, decontaminate, langid, licenses, linededup, minhash, quality, sharding, tokencount, urlfilter
from tidepool.llm import queries as q
from tidepool.llm._words import ALNUM as ALNUM_BYTES
from tidepool.llm._words import NONSPACE, Words, blocks

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns with names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, rep long, cls long, shard int"
OPERATORS = {
    "licenses": lambda d: licenses.labelled(licenses.scan(d)),
    "bpe": lambda d: bpe.encode_texts(d, q.tokenizer_file("word_bpe_49k.json")),
    "decontaminate": lambda d: decontaminate.find_hits(d, d.sparkSession.createDataFrame([(1, "seven words of a test item stand here")], "item_id long, text string")),
    "sharding": lambda d: sharding.shard(d, 3),
    "urls": lambda d: urlfilter.filter_urls(d, q.URL_RULES, "doc_id", "text"),
    "counts": lambda d: tokencount.token_counts(d, q.tokenizer_file("piece_bpe_32k.model")),
    "language": lambda d: langid.predict(d, {"en": b"the of and " * 50, "de": b"der die und " * 50}),
    "quality": lambda d: quality.quality_rules(d),
    "near": lambda d: minhash.near_duplicates(d),
}


def table(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, None, None, None, 1, 2, 3, 4, 5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = "word" * 20_000 + " " + "a b c d e f g " * 3000


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    texts = [None, "", " \n\t", "seven words of a test item stand here", "seven words of a test item stand here", "ÄÖ é 日本 İΣ", LONG, "\x1ć"]
    got = OPERATORS[name](table(spark, texts, [0, 1, 2, 3, 3, None, 6, 7])).collect()
    assert len(got) == len(texts)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i in [0, 1, 2, 3, 3, None, 6, 7])
    same = [{k: v for k, v in r.asDict().items() if k != "slot"} for r in got if r.doc_id == 3]
    assert same[0] == same[1]
    assert OPERATORS[name](table(spark, [])).count() == 0


def test_lines_odd_rows(spark):
    d = table(spark, [None, "", "a b\n\na b", "A b\nx", LONG + "\n" + LONG])
    got = {(r.doc_id, r.line_no): r.removed for r in linededup.line_matches(d).collect()}
    assert got == {(2, 0): False, (2, 2): True, (3, 0): True, (3, 1): False, (4, 0): False, (4, 1): True}
    texts = {r.doc_id: r.text for r in linededup.dedup_lines(d).collect()}
    assert texts == {0: None, 1: "", 2: "a b\n", 3: "x", 4: LONG}
    assert linededup.dedup_lines(d).columns == d.columns
    assert linededup.line_matches(table(spark, [])).count() == 0


def corpus(seed, n=120, words=400):
    """Random texts with near copies and copies."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(1, 6))) for _ in range(words)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            w = rnd.choice(out).split(" ")
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            out.append(" ".join(w))
        else:
            lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 5))]
            out.append("\n".join(lines))
    return out


def shingle_set(text, size=5):
    w = SPACED.findall(text.translate(LOWER))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def test_near_duplicates_brute_force(spark):
    texts = corpus(1)
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert got == {k: (len(s), find(k), find(k) == k) for k, s in enumerate(sets)}


def test_shared_ids_lose_no_text(spark):
    """Rows that share an id, or have none, are rows of their own; repeated rows are copies, of which one stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    d = table(spark, [a, a, b, c, c + " more", c, c, "", "", a], [0, 5, 5, None, None, None, 9, 1, 1, 0])
    got = sorted((str(r.doc_id), r.text) for r in minhash.keep_one(d).collect())
    assert got == sorted([("0", a), ("5", b), ("9", c), ("1", ""), ("1", "")])
    assert minhash.keep_one(d).columns == d.columns
    none = sorted(r.text for r in minhash.keep_one(table(spark, [c, c, c + " more", b], [None] * 4)).collect())
    assert len(none) == 2 and none[0] == b and none[1].startswith(c)
    rows = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(d).collect()}
    assert rows[5, 26] in ((0, False), (5, True)) and rows[None, 26] == (9, False)


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    """Buckets of more members than HOT, of several size classes, lose no link."""
    rnd = random.Random(14)
    head = [f"h{k}" for k in range(40)]
    texts = [" ".join(head + [f"t{rnd.randrange(6)}" for _ in range(rnd.randrange(14))]) for _ in range(60)]
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    monkeypatch.setattr(minhash, "HOT", 4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_star_of_far_copies_keeps_its_links(spark):
    """Copies that are near to an original and not to each other are one group, whichever centres buckets choose."""
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(40):
        w = list(base)
        for k in rnd.sample(range(400), 5):
            w[k] = f"x{rnd.random()}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    got = minhash.near_duplicates(table(spark, texts)).collect()
    assert {r.component_id for r in got} == {0}


def test_super_minhash_estimates():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = np.concatenate([a[:200], rnd.integers(0, 1 << 63, 100, dtype=np.uint64)])
    sig = minhash.super_minhash(np.concatenate([a, b, a[:1]]), np.array([0, 300, 600, 601, 601]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.08
    assert (sig[3] == np.iinfo(np.uint64).max).all()


def lines_brute(texts):
    """By (row, line): first line of its class, links of the class, and whether the line goes."""
    lines = {(k, n): s for k, t in enumerate(texts) for n, x in enumerate(t.split("\n")) if (s := frozenset(SPACED.findall(x.translate(LOWER))))}
    first = {}
    for p in sorted(lines):
        first.setdefault(lines[p], p)
    links = {p: [r for s, r in first.items() if r != p and 10 * len(s & t) >= 8 * len(s | t)] for t, p in first.items()}
    return {p: (first[s], len(links[first[s]]), p != first[s] or any(x < first[s] for x in links[first[s]])) for p, s in lines.items()}


def matches(spark, texts, **options):
    return {(r.doc_id, r.line_no): ((r.class_id, r.class_line), r.n_links, r.removed) for r in linededup.line_matches(table(spark, texts), **options).collect()}


def test_lines_brute_force(spark, monkeypatch):
    texts = corpus(2, 80)
    want = lines_brute(texts)
    assert any(n for _, n, _ in want.values()) and matches(spark, texts) == want
    assert matches(spark, texts, run=1) == want  # the classic prefix filter
    monkeypatch.setattr(linededup, "LISTED", 8)
    assert matches(spark, texts) == want  # another order of tokens


def test_lines_hot_keys_and_parts(spark, monkeypatch):
    """Groups of near copies, keys of several blocks and parts beyond what is held: no link is lost or counted twice."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    texts = [f"{base} {k}" for k in range(70)] + [f"{base[4:]} {base[:3]}{k} x" for k in range(50)] + corpus(4, 20)
    want = lines_brute(texts)
    assert max(n for _, n, _ in want.values()) > linededup.HOT
    assert matches(spark, texts) == want
    monkeypatch.setattr(linededup, "BLOCK", 16)
    assert matches(spark, texts) == want
    make = linededup._pairer

    def small(*a):
        run = make(*a)

        def inside(batches):
            linededup.PART_MOST = 30  # in the worker
            yield from run(batches)
            linededup.PART_MOST = 1 << 23

        return inside

    monkeypatch.setattr(linededup, "_pairer", small)
    assert matches(spark, texts) == want


def test_one_word_of_ten(spark):
    """A line with one changed word is caught; one with two is not."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [" ".join(words), " ".join([*words[:4], "changed", *words[5:]]), " ".join([*words[:2], "x", "y", *words[4:]]), "alpha beta gamma delta", "alpha beta gamma delta more"]
    assert [r.removed for r in linededup.line_matches(table(spark, texts)).orderBy("doc_id").collect()] == [False, True, False, False, True]


def test_prefix_holds_a_run():
    """Any two different sets of the similarity share neighbours within both prefixes, whatever tokens differ."""
    rnd = random.Random(6)
    for percent in (75, 80, 90):
        for _ in range(4000):
            n = rnd.randint(1, 40)
            x = sorted(rnd.sample(range(60), n))
            y = sorted(set(x) - set(rnd.sample(x, rnd.randint(0, max(1, n // 5)))) | set(rnd.sample(range(60), rnd.randint(0, max(1, n // 6)))))
            if x == y or not y or 100 * len(set(x) & set(y)) < percent * len(set(x) | set(y)):
                continue
            keys = []
            for s in (x, y):
                most = int(linededup.prefix_length(np.array([len(s)]), percent, 2)[0])
                assert len(s) >= linededup.smallest(percent)
                keys.append(set(zip(s[: most - 1], s[1:most])))
            assert keys[0] & keys[1], (percent, x, y)


def test_line_words_are_counted_packed(monkeypatch):
    """Counts leave a task as packed parts, fewer rows than tokens, and come out exact whatever is gathered at once."""
    texts = [*corpus(5, 60), None, "", " ".join(f"w{k}" for k in range(9000))]
    words = Words(*(np.frombuffer((raw := "\n".join(t or "" for t in texts).encode()), np.uint8), np.array([0, len(raw)])), NONSPACE)
    want = collections.Counter(words.hash.tolist())
    for counted, step in ((1 << 21, 100), (500, 7)):
        monkeypatch.setattr(linededup, "COUNTED", counted)
        rows = [b for k in range(0, len(texts), step) for b in linededup._counter(iter([pa.RecordBatch.from_arrays([pa.array(texts[k : k + step], pa.string())], names=["text"])]))]
        if len(rows) == 1:
            assert rows[0].num_rows < len(want) // 4 and rows[0].num_rows <= 1 << linededup.COUNT_BITS
        by_part = pa.Table.from_batches(rows).sort_by("part")
        got = pa.Table.from_batches(linededup._merger(iter(by_part.to_batches(max_chunksize=50)))).to_pydict()
        many = {np.int64(t).view(np.uint64).item(): n for t, n in zip(got["tok"], got["n"]) if t is not None}
        assert many == {t: n for t, n in want.items() if n > 1} and sum(got["n"]) == want.total()


def test_line_orders_of_close_values():
    """Sorting by the first bits is exact where these tie, and a fingerprint is never forgotten before it was told."""
    rnd = np.random.default_rng(3)
    for values in (rnd.integers(0, 1 << 63, 5000).astype(np.uint64), rnd.integers(0, 90, 5000).astype(np.uint64), np.zeros(0, np.uint64), np.array([5, 4], np.uint64)):
        some, where = linededup._distinct_values(values)
        assert (some == np.unique(values)).all() and (some[where] == values).all() and (values[linededup._order(values)] == np.sort(values)).all()
    key = np.sort(rnd.integers(0, 9, 3000).astype(np.uint32))
    for n, cls in ((rnd.integers(5, 9, 3000), rnd.integers(-40, 40, 3000)), (rnd.integers(5, 1 << 20, 3000), rnd.integers(-(1 << 62), 1 << 62, 3000)), (np.full(3000, 6), rnd.integers(-(1 << 62), 1 << 62, 3000))):
        order = linededup._by_size(key, n, cls)
        assert all((x[order] == x[np.lexsort((cls, n, key))]).all() for x in (key, n, cls))
    seen = linededup._Seen(bits=4)
    told = collections.Counter()
    for _ in range(40):
        some = rnd.integers(-3, 60, 20) << 55
        fresh = seen.fresh(some)
        assert len(set(some[fresh].tolist())) == fresh.sum()
        told.update(some[fresh].tolist())
        assert set(some.tolist()) <= set(told)


def test_candidate_filter(spark):
    """All fingerprints pass, and few others even of a quarter million."""
    rnd = np.random.default_rng(8)
    some = np.concatenate([rnd.integers(-(1 << 63), (1 << 63) - 1, 250_000), [0, -1, 1, -(1 << 63)]])
    bloom = linededup._bloom(spark.createDataFrame(pa.table({"cls": some})))
    assert linededup._may_hold(bloom, some.view(np.uint64)).all()
    assert linededup._may_hold(bloom, rnd.integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2)).mean() < 0.01


def test_lines_of_shared_ids(spark):
    d = table(spark, ["the same line", "the same line", "unique words stay here", "the same line\nand more", "the same line\nand more"], [0, 1, 1, None, None])
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in linededup.dedup_lines(d).collect())
    # rows without an id come first, and repeated rows keep their first lines each
    assert got == [(False, 0, "the same line\nand more")] * 2 + [(True, 0, ""), (True, 1, ""), (True, 1, "unique words stay here")]


def test_whole_copies_stay(spark):
    long = "\n".join(f"line {k} has words of its own {k * k}" for k in range(9))
    menu = "the menu that every page of this site has\n"
    texts = [menu + "start page and what it says", menu + long, menu + long + "\none more line", "start page and what it says\nother words stand in this text", menu]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(table(spark, texts), leave_copies=80, drop_empty=True).collect()}
    assert got == {0: texts[0], 1: long, 2: long + "\none more line", 3: "other words stand in this text"}


def test_decontamination_brute_force_and_blocks(spark):
    rnd = random.Random(5)
    texts = corpus(3, 60, 30)
    items = [(k, " ".join(rnd.choice(texts).split()[:n])) for k, n in enumerate((1, 2, 3, 13, 14, 20, 30))] + [(8, None), (9, "?"), (None, texts[0][:20])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for k in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(13, len(w))])].add(i)
    want = {}
    for k, t in enumerate(texts):
        w, hit, which = ALNUM.findall(t.translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    which |= windows[tuple(w[a : a + n])]
        want[k] = (len(w), sorted(hit), sorted(str(i) for i in which if i is not None))
    for size in (8 << 20, 40):
        found = decontaminate.find_hits(table(spark, texts), bench, block_bytes=size).collect()
        assert {r.doc_id: (r.n_words, r.hit_words, r.items) for r in found} == want
    left = decontaminate.decontaminate(table(spark, texts), bench).collect()
    assert {r.doc_id for r in left} == {k for k, (n, h, _) in want.items() if not (h and 20 * len(h) >= n)}
    cut = decontaminate.decontaminate(table(spark, ["aa bb cc dd"]), spark.createDataFrame([(1, "BB cc")], "item_id long, text string"), "spans").first()
    assert cut.text == "aa  dd"


def test_decontaminate_judges_the_hits_of_all_blocks(spark):
    """Three words in a hundred from each of two blocks are six; a cut makes and hides no window of a later block."""
    fill = [f"w{k}" for k in range(94)]
    texts = [" ".join(["aa bb cc", *fill, "dd ee ff"]), " ".join(["aa bb cc", *fill, "x y z"]), None, "", "p q q r r", "k l m n o"]
    bench = spark.createDataFrame([(1, "aa bb cc"), (2, "dd ee ff"), (3, "q q"), (4, "p r"), (5, "k l m"), (6, "m n o")], "item_id long, text string").coalesce(1)
    for size in (8 << 20, 1):
        left = decontaminate.decontaminate(table(spark, texts), bench, block_bytes=size)
        assert left.columns == table(spark, []).columns
        assert {r.doc_id for r in left.collect()} == {1, 2, 3}
        cut = {r.doc_id: r.text for r in decontaminate.decontaminate(table(spark, texts), bench, "spans", block_bytes=size).collect()}
        assert cut == {0: " " + " ".join(fill) + " ", 1: " " + " ".join([*fill, "x y z"]), 2: None, 3: "", 4: "p  r r", 5: ""}


def test_hits_of_several_blocks_stay_with_their_rows(spark):
    """Repeated rows, and other texts of as many words with the same or a null id, keep rows of their own."""
    texts = ["aa bb cc dd", "aa bb cc dd", "x dd ee ff", "u v w z", "aa bb x y", "p dd ee ff", None]
    bench = spark.createDataFrame([(1, "aa bb"), (2, "dd ee ff"), (3, "bb cc")], "item_id long, text string").coalesce(1)
    found = [
        sorted((str(r.doc_id), r.n_words, r.hit_words, r.items, [tuple(s) for s in r.spans]) for r in decontaminate.find_hits(table(spark, texts, [1, 1, 1, 1, None, None, 2]), bench, block_bytes=size).collect())
        for size in (8 << 20, 1)
    ]
    assert len(found[0]) == len(texts) and found[0] == found[1]
    assert ("1", 4, [0, 1, 2], ["1", "3"], [(0, 8)]) in found[1] and ("None", 4, [1, 2, 3], ["2"], [(2, 10)]) in found[1]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = q.tokenizer_file("word_bpe_49k.json")
    whole, mine, rnd = Tokenizer.from_file(path), bpe.Coder(path, 16), random.Random(6)
    pools = ["abcdefghij", "aaab", "éèüñß", "日本語", "0123", "!?.,'-", "'stredvm", "İΣσςKﬁ", "éä", " \t\n", "\x1c\x85\xa0 ", "한국", "🙂🏽", "ABC. d,"]
    for _ in range(1500):
        text = "".join(rnd.choice(rnd.choice(pools[a : a + 3])) for a in [rnd.randrange(12)] for _ in range(rnd.choice([0, 3, 40, 300])))
        if rnd.random() < 0.2:
            text = text[:20] + "<|endoftext|>" + text[20:]
        ids = whole.encode(text, add_special_tokens=False).ids
        assert encoded(mine, [text]) == [(len(ids), " ".join(map(str, ids)), whole.decode(ids, skip_special_tokens=False))], repr(text)
    assert mine.tree.windows > 100 and mine.joins > 1000


def encoded(coder, texts):
    out = []
    for lo, hi, raw, offsets in blocks(pa.array(texts, pa.string()), bpe.BLOCK):
        found = coder.encode(raw, offsets)
        out += [(int(found.n[k]), bytes(found.ids(k)).decode(), bytes(found.decoded(k)).decode()) for k in range(hi - lo)]
    return out


def test_bpe_joins_ordinary_texts():
    """Every text over a leaf is encoded in halves, cut inside words too, and each join agrees with its window."""
    from tokenizers import Tokenizer

    path = q.tokenizer_file("word_bpe_49k.json")
    whole, rnd = Tokenizer.from_file(path), random.Random(3)
    texts = [" ".join("".join(rnd.choice("aeinrstéü") for _ in range(rnd.randint(1, 12))) + rnd.choice(["", "", ".", ",", "'s"]) for _ in range(900)) for _ in range(6)] + ["short", "", None]
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for leaf in (2048, 256):
        mine = bpe.Coder(path, leaf)
        got = encoded(mine, texts)
        assert [(n, ids) for n, ids, _ in got] == [(len(w), " ".join(map(str, w))) for w in want]
        assert [d for *_, d in got] == [whole.decode(w, skip_special_tokens=False) for w in want]
        assert mine.joins >= 6 * (len(texts[0]) // leaf) and mine.whole == 0
    assert mine.joins > 100


def test_bpe_round_trip(spark):
    d = table(spark, ["hello world. again", None, "", "hello"])
    got = bpe.round_trip(d, q.tokenizer_file("word_bpe_49k.json")).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["hello</w> world</w> .</w> again</w>", None, "", "hello</w>"]


def test_bpe_query_digests(spark):
    path = q.tokenizer_file("word_bpe_49k.json")
    got = bpe.encode_digests(table(spark, ["Hello, World", None]), path).orderBy("doc_id").collect()
    from tokenizers import Tokenizer

    e = Tokenizer.from_file(path).encode("Hello, World", add_special_tokens=False)
    assert got[0].ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
    assert (got[1].n_tokens, got[1].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_counts_equal_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    rnd = random.Random(7)
    for trial in range(400):
        vocabulary = [("<unk>", 0.0)] + list({"".join(rnd.choice("ab▁c.") for _ in range(rnd.randint(1, 4))): -rnd.randint(1, 4) / rnd.choice([1, 3]) for _ in range(12)}.items())
        whole = Tokenizer(models.Unigram(vocabulary, unk_id=0))
        whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
        mine = tokencount.Counter(vocabulary)
        for _ in range(5):
            text = "".join(rnd.choice("abcdé. ▁\n") for _ in range(rnd.randint(0, 30)))
            assert mine.count(text) == len(whole.encode(text).ids), (vocabulary, text)


def test_counts_with_bytes():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = tokencount.load_vocabulary(q.tokenizer_file("piece_bpe_32k.model"))
    whole = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    mine = tokencount.Counter(vocabulary)
    for text in ("The cat. sat,", "日本🙂🙂x é", "a" * 500, "▁▁x <0x41> <unk>", "́☃☄"):
        assert mine.count(text) == len(whole.encode(text).ids)


def test_urls(spark):
    urls = ["http://A.Example.com/en/7?x", "https://example.com/en/6", "http://x.net/de/", "http://b.example.net/de/88#a", "http://xnet/de/", "ftp://org/es/", "com/en/", None, "http://q.com?/en/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [("allow", "example.com/en/7"), ("block", "com/en/"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("allow", None), ("block", "org/es/"), ("allow", None), ("allow", None), ("allow", None)]
    for size in (100, 2):
        got = urlfilter.filter_urls(rows, q.URL_RULES, block_rules=size).orderBy("page_id").collect()
        assert [(r.verdict, r.rule) for r in got] == want
    assert [r.host for r in got][:2] == ["a.example.com", "example.com"] and got[8].path == ""
    index = urlfilter.DigestArray([("block", "a/x"), ("allow", "b/x")])
    digests, offsets, verdicts, _ = index.mapped()
    other = np.frombuffer(b"?/?!/!", np.uint8)  # equal digests, other strings: no verdict
    assert index.longest([("a", "/x")], (digests, offsets, verdicts, other)) == [None]
    assert index.longest([("a", "/x")], index.mapped()) == [(3, True, "a/x", "block")]


def test_url_ties_and_blocks(spark):
    """Of rules as long as each other block wins, however the rules are dealt; copies and empty tables keep their rows."""
    rules = [("allow", "a.com/x"), ("block", "com/xab"), ("allow", "b.com/yz"), ("allow", "com/yzzz"), ("block", "c.com/"), ("allow", "c.com/")]
    urls = ["http://a.com/xabc", "http://b.com/yzzzz", "http://c.com/", "http://c.com/", None, "http://" + "d." * 2000 + "c.com/" + "x" * 50_000]
    rows = spark.createDataFrame([(k // 2, u) for k, u in enumerate(urls)], "page_id long, url string")
    want = sorted([(0, "com/xab", "block"), (0, "com/yzzz", "allow"), (1, "c.com/", "block"), (1, "c.com/", "block"), (2, None, "allow"), (2, "c.com/", "block")], key=str)
    for size in (100, 2, 1):
        got = urlfilter.filter_urls(rows, rules, block_rules=size).collect()
        assert sorted([(r.page_id, r.rule, r.verdict) for r in got], key=str) == want, size
    assert urlfilter.filter_urls(rows.where("false"), rules).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(rows, [], default="block").collect()} == {"block"}


def test_every_language_is_learned(spark):
    rows = [(k, f"w{k % 80:02d}x " * 30, f"l{k % 80:02d}") for k in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.fit(d.where("doc_id < 160"))
    assert len(learned) == 80
    assert all(r.lang_pred == f"l{r.doc_id % 80:02d}" for r in langid.predict(d.where("doc_id >= 160"), learned).collect())


def test_language(spark):
    rnd = random.Random(8)
    kinds = {"aa": ["bar", "lom", "tis", "que"], "bb": ["zwu", "och", "erg", "ich"]}
    rows = [(k, " ".join("".join(rnd.choices(kinds[lang], k=2)) for _ in range(40)), lang) for k in range(200) for lang in [rnd.choice(list(kinds))]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.fit(d.where("doc_id % 2 = 0"), sample_rows=20)
    assert set(learned) == set(kinds) and len({len(x) for x in learned.values()}) == 1
    got = {r.doc_id: r for r in langid.predict(d, learned).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in rows if k % 2) >= 98
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = langid.predict(d.limit(1).selectExpr("doc_id", "'12 ?' AS text"), learned).first()
    assert (odd.lang_pred, odd.score) == ("und", 0.0)
    assert langid.fit(d.where("false")) == {} and langid.predict(d, {}).first().lang_pred == "und"


def test_a_tiny_language_leaves_the_others_whole(spark):
    rnd = random.Random(10)
    kinds = {"bb": ["bar", "lom", "tis", "que"], "cc": ["zwu", "och", "erg", "ich"]}
    rows = [(k, " ".join("".join(rnd.choices(kinds[lang], k=2)) for _ in range(40)), lang) for k in range(120) for lang in [rnd.choice(list(kinds))]]
    d = spark.createDataFrame(rows + [(900, "one short text", "aa"), (901, "", "ab"), (902, None, "ac"), (903, "", "bb")], "doc_id long, text string, lang string")
    learned = langid.fit(d.where("doc_id % 2 = 0 OR doc_id > 900"), sample_rows=20)
    assert learned["aa"] == b"one short text" and set(learned) == {"aa", "bb", "cc"}
    assert all(len(learned[lang]) > 5000 for lang in kinds)
    got = {r.doc_id: r.lang_pred for r in langid.predict(d, learned).collect()}
    assert sum(got[k] == lang for k, _, lang in rows if k % 2) >= 58


def test_shards(spark):
    rnd = random.Random(9)
    texts = ["hot text " * 3] * 700 + ["x" * rnd.randint(0, 400) + str(rnd.random()) for _ in range(1500)]
    got = sharding.shard(table(spark, texts), 8).collect()
    assert len(got) == len(texts) and all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.03 * sum(sizes.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark):
    """Sizes and checksums by brute force for null, empty, non-ASCII, repeated and very long texts; equal texts keep together."""
    texts = [None, "", "é日🙂", "x" * 300_000, "same", "same", "same"] + [f"t{k} " * (k % 9) for k in range(400)]
    got = {r.doc_id: r for r in sharding.shard(table(spark, texts), 4).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert (got[k].size, got[k].text_crc32) == (len(raw) + 1, zlib.crc32(raw)), k
    assert len({got[k].shard for k in (4, 5, 6)}) == 1
    assert all(sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values()))) for s in range(4))
    assert sharding.shard(table(spark, []), 4).count() == 0


def license_brute(text, rules, base):
    """Base columns and labels without a prefilter: patterns on words joined by blanks, a span that an earlier one of its rank covers goes."""
    words = ALNUM.findall((text or "").translate(LOWER))
    places = sorted((k, label) for phrase, label in base.items() for p in [phrase.split()] for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p)
    joined = "".join(w + " " for w in words)
    spans = []
    for k, (label, priority, _, pattern) in enumerate(rules):
        for m in re.finditer(f"(?<![^ ])(?:{pattern}) ", joined):
            first = joined[: m.start()].count(" ")
            spans.append((first, -(first + m[0].count(" ")), -priority, k, label))
    kept = []
    for s in sorted(spans):
        if not any(x[0] <= s[0] and -x[1] >= -s[1] and x[2] <= s[2] for x in kept):
            kept.append(s)
    labels = sorted({x for _, x in places} | {s[4] for s in kept})
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})), ",".join(labels)


def test_licenses_brute_force(spark):
    rnd = random.Random(15)
    parts = ["cc by", "CC-BY 4.0", "general public license", "GNU General Public License version 2", "all rights reserved", "All Rights", "mit license", "Apache License 2.0", "public", "license",
             "é", "LGPLv3", "bsd 3 clause license", "mozilla public license 2.0", "word", "reserved", "by", "\x00", "K"]
    texts = [rnd.choice([" ", "\n", ", "]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(150)] + [None, "", "cc by " * 20_000]
    got = licenses.labelled(licenses.scan(table(spark, texts))).collect()
    for r in got:
        have = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        assert have == license_brute(texts[r.doc_id], licenses.RULES, licenses.BASE), texts[r.doc_id][:200]


def test_licenses(spark):
    texts = ["Released under the MIT License.", "x CC-BY-NC 4.0, cc by! All rights  reserved", "GNU General Public License, version 3", "no rule here", "Ⅽc by\x00CC\x01BY"]
    got = licenses.labelled(licenses.scan(table(spark, texts))).orderBy("doc_id").collect()
    assert got[0].labels == "mit" and got[0].n_base == 0 and got[0].score == 1.0
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 1, 8, "cc-by,reserved")
    assert got[1].labels == "cc-by,cc-by-nc-4.0,reserved"
    assert got[2].labels == "gpl,gpl-3.0" and got[3].labels == "" and got[3].score == 0.0
    assert (got[4].n_base, got[4].first_word) == (1, 2)
    assert len(licenses.RULES) > 200


def matched(pattern, rnd):
    """A random text that a rule's pattern matches."""
    out = ""
    for op, x in pattern:
        op = str(op)
        if op == "LITERAL":
            out += chr(x)
        elif op == "NOT_LITERAL":
            out += "w"
        elif op == "IN":
            kind, x = rnd.choice(x)
            out += chr(x if str(kind) == "LITERAL" else rnd.randint(*x))
        elif op == "MAX_REPEAT":
            out += "".join(matched(x[2], rnd) for _ in range(rnd.randint(x[0], min(x[1], x[0] + 1))))
        elif op == "SUBPATTERN":
            out += matched(x[3], rnd)
        else:
            assert op == "BRANCH", op
            out += matched(rnd.choice(x[1]), rnd)
    return out


def test_keywords_lose_no_match(spark):
    """Scanning with the prefilter, and with one that every text passes for every rule, finds the same."""
    rnd = random.Random(11)
    texts = ["LGPLv2.1 all", "LGPLv3 all", "AGPLv3 all", "GPL2 all", "GPL3 all", "GPLv2.0 only all", "LGPL2.1 all", "LGPL3 all", "AGPL3 all"]
    texts += sorted({f"{matched(re._parser.parse(p), rnd)} all" for _, _, _, p in licenses.RULES for _ in range(8 if " ?" in p else 2)})
    d = table(spark, texts)
    got = {r.doc_id: r.detections for r in licenses.scan(d).collect()}
    assert [{x.label for x in got[k]} for k in range(5)] == [{"lgpl-2.1"}, {"lgpl-3.0"}, {"agpl-3.0"}, {"gpl-2.0"}, {"gpl-3.0"}]
    every = [(label, priority, "all", pattern) for label, priority, _, pattern in licenses.RULES]
    assert got == {r.doc_id: r.detections for r in licenses.scan(d, rules=every).collect()}


def test_containment(spark):
    rules = [("low", 1, "a", "a b c"), ("high", 3, "b", "b"), ("wide", 2, "a", "a b c d"), ("same", 2, "d", "d")]
    found = licenses.scan(table(spark, ["a b c d e"]), rules=rules, base={}).first().detections
    assert [(s.label, s.first, s.end) for s in found] == [("wide", 0, 4), ("high", 1, 2)]


def test_quality(spark):
    texts = ["word " * 60, " ".join(f"w{k}" for k in range(60)) + " the of and", "a#b\n\na#b\na#b ", "x y z x y z", None]
    got = quality.quality_rules(table(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in got] == [60, 0, 0, 6, 0] and [r.base_failed for r in got] == [True, False, True, True, True]
    assert (got[2].n_symbols, got[2].n_dup_lines, got[2].word_chars) == (3, 1, 9)
    assert [r.doc_id for r in quality.keep_good(table(spark, texts)).collect()] == [1]


def test_quality_can_be_filtered(spark):
    """A filter on what the rules give is one more step of the plan, not all measures again for each use."""
    texts = ["word " * 60, " ".join(f"w{k}" for k in range(60)) + " the of and", "a#b", None] * 10
    found = quality.quality_rules(table(spark, texts))
    began = time.time()
    assert found.where("kept").count() == 10 and found.where("NOT kept AND n_words > 50").count() == 10
    assert [r.n_words for r in found.where("base_failed").select("n_words").distinct().orderBy("n_words").collect()] == [0, 1, 60]
    assert time.time() - began < 60
    plan = found.where("kept AND n_repeat_words = 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_words_of_long_texts():
    """Words don't depend on the pieces that bytes are taken in."""
    rnd = random.Random(16)
    text = "".join(rnd.choice("ab é日 \n.") for _ in range(400_000)).encode() + b"x" * 600_000 + b" end"
    raw = np.frombuffer(text, np.uint8)
    got = Words(raw, np.array([0, 7, 7, 300_000, len(raw)]), ALNUM_BYTES)
    assert got.text(len(got.start) - 1) == b"end"
    same = {}
    for k in rnd.sample(range(len(got.start)), 3000):
        assert same.setdefault(got.text(k), int(got.hash[k])) == int(got.hash[k])
    one = Words(np.frombuffer(b"q " + b"x" * 600_000, np.uint8), np.array([0, 600_002]), ALNUM_BYTES)
    assert one.hash[1] == got.hash[-2] and one.text(1) == got.text(len(got.start) - 2)


def test_counts_of_a_table(spark):
    texts = ["The cat. sat,", None, "", "日本🙂 x", "The cat. sat,", "word " * 3000]
    path = q.tokenizer_file("piece_bpe_32k.model")
    mine = tokencount.Counter(tokencount.load_vocabulary(path))
    rows = tokencount.token_counts(table(spark, texts), path).orderBy("doc_id").collect()
    assert [r[1] for r in rows] == [mine.count(t or "") for t in texts]


def test_quality_stage_carries_clashing_columns_and_judges_each_row(spark):
    good = " ".join(f"the word{k} of" for k in range(40))
    rows = [(1, good, 5, "x"), (1, "too short", 6, "y"), (None, good, 7, None), (2, None, 8, "z"), (3, "", 9, "w"), (4, good, None, "v"), (4, good, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    got = quality.keep_good(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[5], rows[6]], key=str)
    assert quality.keep_good(docs.where("false")).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Exchange" not in plan
