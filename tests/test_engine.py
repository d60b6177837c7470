import random

import pytest
from pyspark.sql import functions as F

from tidepool.functions import text as tx
from tidepool.operators import candidates, chunking, contracts, evaluate, fitting, lexical, scoring
from tidepool.operators.search import search, suppress_overlaps
from tidepool.plans import ranking, render
from tidepool.sources import tables, tree


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def sources(spark, texts):
    rows = [(k, p, t) for k, (p, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "source_id long, path string, text string").withColumn("len_bytes", F.octet_length("text").cast("long"))


def chunks(spark, rows):
    """(source, path, start, end, text), numbered in order."""
    rows = [(k, s, p, a, b, 1, 1, "lines", t) for k, (s, p, a, b, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "chunk_index long, source_id long, path string, start_byte long, end_byte long, start_line int, end_line int, kind string, passage string")


def test_terms_split_identifiers(spark):
    got = column(spark, ["maxRows_kb4 XMLReader", "__ a", "ＡＢ ﬁ", "ΟΔΟΣ"], tx.terms)
    assert got[0] == ["maxrows_kb4", "max", "rows", "kb", "4", "xmlreader", "xml", "reader"]
    assert got[1] == ["a"] and got[2] == ["ab", "fi"] and got[3] == ["οδοσ"]
    for s in ["maxRows_kb4 XMLReader", "src3 en the MIT v3"]:
        assert tx.query_terms(s) == list(dict.fromkeys(column(spark, [s], tx.terms)[0]))


def test_token_estimate(spark):
    assert column(spark, ["foo_bar", "fn a_b(x) {}", "日本 ab", ""], tx.token_estimate) == [3, 9, 3, 0]


def test_planner_counts_like_the_estimate(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab_ .日\n\té9") for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    assert [chunking.Text(t).count(0, len(t)) for t in texts] == column(spark, texts, tx.token_estimate)


def naive_plan(text, c):
    """The planner's rules without prefix sums, for short texts."""
    t = chunking.Text(text)
    fits = lambda a, b: t.bytes[b] - t.bytes[a] <= c.max_bytes and t.line(b - 1) - t.line(a) + 1 <= c.max_lines and chunking.Text(text[a:b]).tokens[-1] <= c.target_tokens
    out, start, covered = [], 0, 0
    while start < len(text) and not t.is_blank(start, len(text)):
        ends = [e for e in t.ends if e > max(start, covered) and fits(start, e)]
        if ends:
            blank = [e for e in ends if e in t.blank]
            if start not in t.starts:
                end, kind = ends[-1], "long_line"
            elif blank and not t.is_blank(start, blank[-1]):
                end, kind = blank[-1], "paragraph"
            else:
                end, kind = ends[-1], "lines"
        elif start < covered:
            start = covered
            continue
        else:
            good = [e for e in range(start + 1, len(text) + 1) if fits(start, e)]
            white = [e for e in good if text[e - 1] in tx.WHITE_SPACE]
            end, kind = (white or good or [start + 1])[-1], "long_line"
        if not t.is_blank(start, end):
            out.append((start, end, kind))
        covered, best = end, end
        if c.overlap_tokens and end < len(text):
            while best > start and t.bytes[end] - t.bytes[best - 1] <= c.max_bytes and chunking.Text(text[best - 1 : end]).tokens[-1] <= c.overlap_tokens:
                best -= 1
        start = end if best <= start else best
    return out


def test_planner_against_naive():
    rnd = random.Random(7)
    for _ in range(300):
        text = "".join(rnd.choice(["ab", "c ", "\n", "\n\n", "日", "é.", "x_1 "]) for _ in range(rnd.randint(0, 40)))
        target = rnd.randint(2, 8)
        c = chunking.ChunkConfig(target, rnd.randint(0, target - 1), rnd.randint(1, 4), rnd.randint(4, 30))
        assert [(a, b, k) for a, b, k, _ in chunking.plan(text, c)] == naive_plan(text, c), (text, c)


def test_chunks_cover_texts(spark):
    texts = [("a", "x\n" * 4000), ("b", "  \n\t"), ("c", "a\r\n한글 🙂\r\nlast"), ("d", "🙂" * 20)]
    got = chunking.number(chunking.chunk(sources(spark, texts), chunking.ChunkConfig(overlap_tokens=0))).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got)))
    for k, (_, text) in enumerate(texts):
        own = [r for r in got if r.source_id == k]
        assert "".join(r.passage for r in own) == (text if text.strip() else "")
        assert all(text.encode()[r.start_byte : r.end_byte].decode() == r.passage for r in own)
    assert len([r for r in got if r.source_id == 0]) == 100
    with pytest.raises(ValueError):
        chunking.ChunkConfig(overlap_tokens=33)


def test_fit_rebuilds_and_fails_on_one_character(spark):
    whole = chunks(spark, [(0, "a", 0, 0, "one two\nthree four é\r\nfive")])
    for limit in (6, 9, 50):
        got = fitting.fit(whole, "q", limit, lambda q, p: len(q) + len(p) + 3).orderBy("start_byte").collect()
        assert "".join(r.passage for r in got) == "one two\nthree four é\r\nfive" and all(len(r.passage) + 4 <= limit for r in got)
    with pytest.raises(fitting.PairTooLong):
        list(fitting.fit_passage("ab", lambda p: 9, 3))


def test_line_index(spark):
    s = sources(spark, [("a", "é\r\nb\n"), ("b", "")])
    got = [(r.source_id, r.line, r.start_byte, r.end_byte) for r in tables.line_index(s).orderBy("source_id", "line").collect()]
    assert got == [(0, 1, 0, 4), (0, 2, 4, 6), (0, 3, 6, 6), (1, 1, 0, 0)]


def test_policy_and_budget(spark):
    s = sources(spark, [("a/1", "x\0"), ("a/2", "abc"), ("a-b", "d"), ("b/1", "e")])
    assert [r.policy for r in tables.content_policy(s).orderBy("source_id").collect()] == ["nul_byte", "ok", "ok", "ok"]
    order = [r.path for r in ranking.global_rank(s, [tx.path_order(F.col("path"))], "n").orderBy("n").collect()]
    assert order == ["a/1", "a/2", "a-b", "b/1"]
    assert sorted(r.path for r in tables.byte_budget(s, 5).collect()) == ["a/1", "a/2"]


def test_bm25_path_and_ties(spark):
    c = chunks(spark, [(0, "x/retry.txt", 0, 5, "alpha"), (1, "y/b.txt", 0, 5, "retry retry"), (2, "z/c.txt", 0, 5, "retry retry")])
    got = lexical.score(c, "retry").orderBy(*lexical.ranking_order()).collect()
    assert [r.chunk_index for r in got][-2:] == [1, 2] or [r.chunk_index for r in got][:2] == [1, 2]
    assert next(r for r in got if r.chunk_index == 0).body_score == 0
    assert lexical.score(c, "absent").count() == 0


def test_midpoint_and_spread(spark):
    def halves(lo, hi):
        out, todo = [], [(lo, hi)]
        while todo:
            a, b = todo.pop(0)
            if a < b:
                m = a + (b - a) // 2
                out.append(m)
                todo += [(a, m), (m + 1, b)]
        return out

    for n in (1, 2, 3, 7, 20):
        c = chunks(spark, [(0, "p", k, k + 1, "t") for k in range(n)])
        assert [r.chunk_index for r in candidates.midpoints(c).orderBy("midpoint_rank").collect()] == halves(0, n)
        c = chunks(spark, [(k, f"p{k:03d}", 0, 1, "t") for k in range(n)])
        want = [0] if n == 1 else [0, n - 1, *halves(1, n - 1)]
        assert [r.source_id for r in candidates.spread(c).orderBy("spread_rank").collect()] == want


def test_quota():
    assert {k: tuple(candidates.quota(k).values()) for k in (1, 3, 4, 8, 128)} == {1: (1, 0, 0, 0), 3: (2, 1, 0, 0), 4: (3, 1, 0, 0), 8: (5, 1, 1, 1), 128: (80, 16, 16, 16)}


def test_fast_equals_deep_when_all_are_candidates(spark):
    c = chunks(spark, [(k, f"p{k}", 0, 9, w) for k, w in enumerate(["alpha beta", "beta", "gamma", "alpha"])])
    rows = [[(r.rank, r.chunk_index) for r in search(c, "alpha beta", m, scorer=scoring.CoverageScorer()).results.orderBy("rank").collect()] for m in ("fast", "deep")]
    assert rows[0] == rows[1] and rows[0][0] == (1, 0)
    fast = search(c, "alpha beta", "fast", candidate_limit=2, scorer=scoring.CoverageScorer())
    assert fast.scoring_complete is False and fast.chunks_evaluated == 2
    assert search(c, "alpha").scoring_complete is None
    with pytest.raises(ValueError):
        search(c, "x", "deep")


def test_bad_scorers_are_fatal(spark):
    class Bad:
        def score_batch(self, query, passages):
            return [float("nan")] * len(passages)

    c = chunks(spark, [(0, "p", 0, 1, "a")])
    with pytest.raises(Exception, match="not finite"):
        scoring.score(c, "q", Bad()).collect()


def test_suppression_against_loop(spark):
    rnd = random.Random(3)
    spans = [(rnd.randint(0, 2), "p", a := rnd.randint(0, 60), a + rnd.randint(1, 30), "t") for _ in range(80)]
    c = chunks(spark, spans)
    kept = []
    for k, (s, _, a, b, _) in sorted(enumerate(spans), key=lambda x: x[0]):
        if not any(t == s and max(0, min(b, y) - max(a, x)) / min(b - a, y - x) >= 0.6 for _, t, x, y in kept):
            kept.append((k, s, a, b))
    assert sorted(r.chunk_index for r in suppress_overlaps(c, [F.asc("chunk_index")]).collect()) == [k[0] for k in kept]


def test_metrics_count_a_label_once(spark):
    q = spark.createDataFrame([("q", "dev")], "query_id string, split string")
    labels = spark.createDataFrame([("q", "e", "p", 0, 10, 2)], "query_id string, evidence_id string, path string, start_byte long, end_byte long, relevance int")
    res = spark.createDataFrame([("q", "deep", "p", 50, 60, 1), ("q", "deep", "p", 0, 6, 2), ("q", "deep", "p", 0, 10, 3)], "query_id string, mode string, path string, start_byte long, end_byte long, rank int")
    m = evaluate.metrics(q, labels, res).first()
    assert (m.hit_at_5, m.mrr_at_10) == (True, 0.5) and abs(m.ndcg_at_10 - 0.6309297) < 1e-6
    assert evaluate.missing_events(q, ["deep", "fast"], res).collect()[0].mode == "fast"
    with pytest.raises(contracts.ContractError):
        contracts.require(q, "no query may be there")


def test_tree(spark, tmp_path):
    for name, data in {"keep.txt": b"alpha\n", "drop.log": b"x", "sub/back.log": b"y", ".hid": b"z", "nul.txt": b"a\0", "bad.txt": b"\xff\xfe", "_u.txt": b"u"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / ".ignore").write_text("*.log\n!back.log\n")
    (tmp_path / "link").symlink_to(tmp_path / "keep.txt")
    found = tree.read_tree(spark, str(tmp_path))
    rows = found.where("kind <> 'entries_seen'").collect()
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in rows} == {"keep.txt": "ok", "back.log": "ok", "nul.txt": "nul_byte", "bad.txt": "invalid_utf8", "_u.txt": "ok", "link": "symlink"}
    assert tree.counters(found) == {
        "entries_seen": 7, "files_considered": 5, "files_read": 5, "files_accepted": 3, "bytes_read": 12, "policy_exclusions_observed": 3, "failures": 0
    }
    with pytest.raises(Exception, match="at least 1"):
        tree.read_tree(spark, str(tmp_path), max_file_bytes=0).collect()
    rows = tree.read_tree(spark, str(tmp_path), hidden=True, ignore=False, globs="*.log\n.hid").where("kind = 'ok'").collect()
    assert {r.path.rsplit("/", 1)[1] for r in rows} == {"drop.log", "back.log", ".hid"}
    with pytest.raises(tree.DiscoveryError):
        tree.listing(str(tmp_path / "absent"))


def test_render(spark):
    c = chunks(spark, [(0, "root/a.txt", 0, 5, "alpha")])
    doc = render.document(search(c, "alpha"), "alpha", "root", {0: "alpha\x07"})
    assert doc["results"][0]["path"] == "a.txt" and doc["stats"]["scoring_complete"] is None and render.exit_code(doc) == 0
    assert "\\u{0007}" in render.to_text(doc) and render.exit_code(render.document(search(c, "none"), "none")) == 1
