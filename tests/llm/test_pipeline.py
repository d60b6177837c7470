"""The pipeline against a brute-force version on a small corpus."""

import hashlib

import corpus_pipeline
from test_operators import ALNUM, LOWER, SPACED, corpus, shingle_set

from tidepool.llm import quality
from tidepool.llm import queries as q


def good(text):
    w = SPACED.findall(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    again = {g for g in grams if grams.count(g) > 1}
    covered = {k + i for k, g in enumerate(grams) if g in again for i in range(3)}
    if len(w) < 50 or 100 * len(covered) > 50 * len(w):
        return False
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    chars = sum(map(len, w))
    m = {
        "n_words": len(w), "mean_word_chars": chars / len(w), "symbol_ratio": sum(text.count(c) for c in quality.SYMBOLS) / chars,
        "stop_ratio": sum(x.lower() in quality.STOP_WORDS for x in w) / len(w), "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines),
    }
    return all(len(w) < r.from_words or ((r.least is None or m[r.measure] >= r.least) and (r.most is None or m[r.measure] <= r.most)) for r in quality.RULES)


def brute(docs, items):
    docs = {k: t for k, t in docs.items() if t and good(t)}
    # an earlier line counts whether it stays or not
    lines = {(k, n): s for k in sorted(docs) for n, x in enumerate(docs[k].split("\n")) if (s := frozenset(SPACED.findall(x.translate(LOWER))))}
    source = {}
    for p, s in lines.items():
        source[p] = next(r for r, x in lines.items() if 10 * len(s & x) >= 8 * len(s | x))
    docs2 = {}
    for k in docs:
        own = {p: source[p] for p in lines if p[0] == k}
        stays = sum(len(lines[p]) for p, r in own.items() if r == p)
        shares = {}
        for p, r in own.items():
            if r[0] != k:
                shares[r[0]] = shares.get(r[0], 0) + len(lines[p])
        best = max(shares, key=lambda x: (shares[x], x), default=None)
        if best is not None:
            theirs = sum(len(s) for p, s in lines.items() if p[0] == best and source[p] == p)
            if 100 * shares[best] < 80 * (stays + max(theirs, shares[best])):
                best = None
        gone = {p[1] for p, r in own.items() if r != p and (best is None or r[0] != best)}
        text = "\n".join(x for n, x in enumerate(docs[k].split("\n")) if n not in gone)
        if SPACED.search(text):
            docs2[k] = text
    assert len(docs2) > 2 and any(docs2[k] != docs[k] for k in docs2)
    sets = {k: shingle_set(t) for k, t in docs2.items()}
    group = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    docs3 = {k: t for k, t in docs2.items() if group[k] == k}
    assert len(docs3) < len(docs2)  # copies as a whole reach this stage
    windows = set()
    for t in items:
        w = ALNUM.findall(t.translate(LOWER))
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    done = {}
    for k, t in docs3.items():
        w, hit = ALNUM.findall(t.translate(LOWER)), set()
        for n in {len(x) for x in windows}:
            hit |= {a + i for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in windows for i in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            done[k] = t
    return done


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = dict(enumerate(t.replace("a", "the ") + " of the and " * 2 for t in corpus(11, 70)))
    texts |= {200: None, 201: "", 202: "# " * 80}
    items = [" ".join(texts[0].split()[:20]), " ".join(texts[9].split()[5:30]), "x"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute(texts, items)
    assert set(got) == set(want) and 5 < len(want) < len(texts)
    assert all(r.n_tokens for r in got.values())  # no text without a word comes out
    whole = Tokenizer.from_file(q.tokenizer_file("word_bpe_49k.json"))
    for k, t in want.items():
        ids = whole.encode(t, add_special_tokens=False).ids
        assert list(got[k].ids) == ids and got[k].n_tokens == len(ids)
        assert got[k].decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the of " * 3, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.names == docs.columns
