"""Contracts, reports, the model registry, made corpora, shared caps and the command line."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from test_engine import chunks, sources

from tidepool import cli
from tidepool.operators import chunking, contracts, evaluate, fitting, models, report, scoring
from tidepool.operators.search import suppress_overlaps
from tidepool.plans import ranking, store
from tidepool.sources import corpora, tables, tree


def problems(df):
    return sorted((r.problem, r.subject) for r in df.collect())


def definitions(spark, change=lambda q: q):
    label = {"evidence_id": "e", "path": "a.txt", "start_byte": 0, "end_byte": 5, "start_line": 1, "end_line": 1, "relevance": 2, "rationale": "why"}
    base = [
        {"id": f"{i}-{x}", "intent_id": i, "split": "irrelevant" if i == "n" else "development", "category": "c", "language": x,
         "query_type": "irrelevant" if i == "n" else "relevant", "query": "alpha", "tags": ["t", "korean_to_english"] if x == "ko" else ["t"], "labels": [] if i == "n" else [dict(label)]}
        for i in ("q", "n") for x in ("en", "ko")
    ]
    kind = """id string, intent_id string, split string, category string, language string, query_type string, query string, tags array<string>,
        labels array<struct<evidence_id:string,path:string,start_byte:long,end_byte:long,start_line:int,end_line:int,relevance:int,rationale:string>>"""
    return spark.createDataFrame([change(q) for q in base], kind)


def test_query_and_intent_problems(spark):
    good = definitions(spark)
    assert not problems(contracts.query_problems(good)) and not problems(contracts.intent_problems(good))

    def change(q):
        if q["id"] == "q-ko":
            return q | {"language": "de", "query": " ", "labels": [q["labels"][0] | {"relevance": 1}, q["labels"][0]]}
        return q | ({"id": "n-en", "split": "holdout"} if q["id"] == "n-ko" else {})

    bad = definitions(spark, change)
    assert problems(contracts.query_problems(bad)) == [
        ("duplicate_evidence", "q-ko"), ("duplicate_query_id", "n-en"), ("irrelevant_split", "n-en"), ("missing_query", "q-ko"), ("unknown_language", "q-ko"),
    ]
    assert problems(contracts.intent_problems(bad)) == [("intent_labels", "q"), ("intent_languages", "q"), ("intent_split", "n")]
    assert problems(contracts.count_problems(good, {("development", "c"): 1, ("holdout", "c"): 2}))[0][1].startswith(("holdout:c:2", "irrelevant:c:1"))
    assert problems(contracts.low_overlap_problems(good, ["q", "z"], 3, "t")) == [("too_few_low_overlap_intents", "2"), ("unknown_intent", "z")]
    with pytest.raises(contracts.ContractError, match="unknown_intent"):
        contracts.require(contracts.low_overlap_problems(good, ["z"], 1), "bad list")


def test_label_chunk_and_manifest_problems(spark):
    s = sources(spark, [("a.txt", "alpha é\nb\n"), ("b.txt", "  \n")])
    rows = [("q", "1", "a.txt", 0, 5, 1, 1, 2), ("q", "2", "a.txt", 9, 11, 1, 2, 3), ("q", "3", "b.txt", 0, 2, 1, 1, 1), ("q", "4", "../c", 0, 1, 1, 1, 1), ("q", "5", "a.txt", 8, 99, 1, 1, 1)]
    labels = spark.createDataFrame(rows, "query_id string, evidence_id string, path string, start_byte long, end_byte long, start_line int, end_line int, relevance int")
    assert problems(contracts.label_problems(labels, s)) == [
        ("bad_path", "q:4"), ("bad_relevance", "q:2"), ("blank_evidence", "q:3"), ("outside_file", "q:5"), ("unknown_path", "q:4"), ("wrong_lines", "q:2"),
    ]
    made = [(0, 0, 9, 1, 1), (0, 7, 9, 1, 1), (0, 9, 11, 2, 2), (0, 3, 3, 1, 1), (0, 0, 9, 1, 2), (7, 0, 1, 1, 1), (0, 5, 50, 1, 1)]
    c = spark.createDataFrame(made, "source_id long, start_byte long, end_byte long, start_line int, end_line int")
    assert problems(contracts.chunk_problems(s, c)) == [("empty_range", "0:3:3"), ("invalid_range", "0:5:50"), ("invalid_range", "0:7:9"), ("unknown_source", "7:0:1"), ("wrong_lines", "0:0:9")]
    assert problems(contracts.chunk_problems(s.unionByName(s.limit(1)), c.limit(1))) == [("duplicate_source_id", "0")]
    assert not problems(contracts.chunk_problems(s, chunking.chunk(s)))
    listed = corpora.inventory(s)
    assert not problems(contracts.manifest_problems(listed, s))
    worse = listed.where("path = 'a.txt'").withColumn("sha256", F.lit("0" * 64)).unionByName(spark.createDataFrame([("/x", "AB")], "path string, sha256 string"))
    assert problems(contracts.manifest_problems(worse, s)) == [("bad_digest", "/x"), ("bad_path", "/x"), ("changed_file", "a.txt"), ("missing_file", "/x"), ("unlisted_file", "b.txt")]


EVENT = """query_id string, mode string, chunk_contract_id string, all_chunk_spans array<struct<path:string,start_byte:long,end_byte:long>>,
    candidate_spans array<struct<path:string,start_byte:long,end_byte:long>>, evaluated_spans array<struct<path:string,start_byte:long,end_byte:long>>,
    results array<struct<rank:int,path:string,start_byte:long,end_byte:long,score:double>>, scoring_complete boolean, candidate_limit int"""


def events(spark, **changes):
    every = [("a.txt", 0, 5), ("a.txt", 6, 8)]
    out = []
    for q in ("q-en", "q-ko", "n-en", "n-ko"):
        best = [(1, *every[0], 2.0), (2, *every[1], 1.0)]
        out += [
            {"query_id": q, "mode": "lexical", "chunk_contract_id": "k", "all_chunk_spans": every, "results": best[1:], "candidate_limit": 1},
            {"query_id": q, "mode": "fast", "chunk_contract_id": "k", "all_chunk_spans": every, "candidate_spans": every[:1], "evaluated_spans": every[:1], "results": best[:1], "candidate_limit": 1},
            {"query_id": q, "mode": "deep", "chunk_contract_id": "k", "all_chunk_spans": every, "evaluated_spans": every, "results": best, "scoring_complete": True},
        ]
    names = [x.split()[0] for x in EVENT.replace("array<struct<rank:int,path:string,start_byte:long,end_byte:long,score:double>>", "x").replace("array<struct<path:string,start_byte:long,end_byte:long>>", "x").split(",")]
    for (q, mode), change in changes.get("at", {}).items():
        out = [e | change if (e["query_id"], e["mode"]) == (q, mode) else e for e in out]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in out], EVENT)


def test_event_problems(spark):
    q, s = definitions(spark), sources(spark, [("a.txt", "alpha\nb\n")])
    assert not problems(contracts.event_problems(events(spark), q, s))
    wide = [("a.txt", 0, 5), ("a.txt", 6, 8), ("a.txt", 7, 99)]
    bad = events(spark, at={
        ("q-en", "fast"): {"candidate_spans": wide[:2], "results": [(1, "a.txt", 6, 8, 1.0), (1, "a.txt", 0, 5, float("nan"))]},
        ("q-en", "deep"): {"scoring_complete": None, "evaluated_spans": wide[:1], "chunk_contract_id": "other"},
        ("n-en", "lexical"): {"all_chunk_spans": wide}, ("n-ko", "deep"): {"query_id": "zz"},
    })
    assert problems(contracts.event_problems(bad, q, s)) == [
        ("bad_score", "q-en:fast"), ("candidates_evaluated", "q-en:fast"), ("chunk_sets_differ", "n-en"), ("contracts_differ", "q-en"), ("deep_incomplete", "q-en:deep"), ("deep_not_all", "q-en:deep"),
        ("duplicate_ranks", "q-en:fast"), ("outside_file", "n-en:lexical:a.txt:7"), ("over_candidate_limit", "q-en:fast"), ("results_evaluated", "q-en:deep"), ("results_evaluated", "q-en:fast"),
        ("unknown_query", "zz:deep"),
    ]


def test_report(spark, tmp_path):
    q, e = definitions(spark), events(spark)
    got = report.summary_document(q, e, ["development", "irrelevant"])
    assert got["modes"]["deep"] == {"query_count": 2, "hit_at_5": 1.0, "mrr_at_10": 1.0, "ndcg_at_10": 1.0}
    assert got["modes"]["lexical"]["hit_at_5"] == 0.0 and list(got["modes"]) == ["deep", "fast", "lexical"]
    held = got["modes"]["fast"]["candidate_coverage"]
    assert held["evidence_recall_macro"] == held["hit_rate"] == 1.0 and held["candidate_count"] == {"min": 1, "median": 1.0, "p95": 1.0, "max": 1}
    assert got["groups"]["by_tag"]["korean_to_english"]["deep"]["query_count"] == 1 and set(got["groups"]["by_language"]) == {"en", "ko"}
    assert got["fast_deep_comparison"] == {"query_pair_count": 2, "top10_jaccard_mean": 0.5, "top10_intersection_mean": 1.0, "deep_minus_fast_hit_at_5": 0.0}
    assert got["irrelevant_score_distribution"]["lexical"] == {"n": 2, "lo": 1.0, "median": 1.0, "p95": 1.0, "hi": 1.0}
    row = next(r for r in report.per_query(q, e).collect() if (r.query_id, r["mode"]) == ("q-en", "fast"))
    assert (row.gold_coverability, row.candidate_hit, row.candidate_count, row.top_score) == (1.0, True, 1, 2.0)
    folder = f"file://{tmp_path}/out"
    report.write_report(q, e, ["development"], folder)
    assert json.loads((tmp_path / "out" / "summary.json").read_text())["selected_splits"] == ["development"]
    report.write_events(e, f"{folder}/events")
    back = spark.read.json(f"{folder}/events")
    assert back.count() == 12 and back.where("mode = 'lexical' AND candidate_limit IS NOT NULL").count() == 0
    for again in (lambda: report.write_events(e, f"{folder}/events"), lambda: report.write_document(spark, {}, f"{folder}/summary.json")):
        with pytest.raises(Exception, match="(?i)exist"):
            again()
    assert {r.id for r in report.select_queries(q, ["development"], ["ko"]).collect()} == {"q-ko"}


def test_evidence_pool(spark):
    s = sources(spark, [("a.txt", "alpha beta"), ("b.txt", "gamma")])
    label = lambda p, n: {"evidence_id": p, "path": p, "start_byte": 0, "end_byte": n, "start_line": 1, "end_line": 1, "relevance": 1, "rationale": "r"}
    q = definitions(spark, lambda q: q | {"query": "alpha" if q["language"] == "en" else "alpha beta", "labels": [label("a.txt", 10) if q["language"] == "en" else label("b.txt", 5)]})
    pool = report.evidence_pool(q, s)
    assert {(r.path, r.passage) for r in pool.collect()} == {("a.txt", "alpha beta"), ("b.txt", "gamma")}
    for options in ({"scorer": scoring.CoverageScorer()}, {"score_column": scoring.coverage_score}):
        ranked = report.rerank_pool(q, pool, **options)
        assert {(r.query_id, r.path): (r["rank"], r.relevant) for r in ranked.collect() if r.query_id.startswith("q")} == {
            ("q-en", "a.txt"): (1, True), ("q-en", "b.txt"): (2, False), ("q-ko", "a.txt"): (1, False), ("q-ko", "b.txt"): (2, True)
        }
    got = {r.group: (r.query_count, r.hit_at_5, r.mrr_at_10) for r in report.pool_metrics(q, ranked).collect()}
    assert got == {"all": (4, 1.0, 0.75), "language:en": (2, 1.0, 1.0), "language:ko": (2, 1.0, 0.5), "tag:korean_to_english": (2, 1.0, 0.5)}


def test_fit_all_shares_its_cap(spark):
    s = sources(spark, [("a", "one two three four\nfive six"), ("b", "seven"), ("c", "eight nine ten eleven")])
    counter = lambda q, p: len(q) + len(p) + 3
    raw = chunking.chunk(s)
    whole = fitting.fit(raw, "q", 14, counter).orderBy("source_id", "start_byte").collect()
    for most in (2, 4, len(whole), 100):
        got, split, reached = fitting.fit_all(s, raw, "q", 14, most, counter)
        rows = got.orderBy("chunk_index").collect()
        assert [(r.source_id, r.start_byte, r.passage) for r in rows] == [(r.source_id, r.start_byte, r.passage) for r in whole[:most]]
        assert [r.chunk_index for r in rows] == list(range(len(rows))) and reached == (most < len(whole))
        assert split == len({r.source_id for r in whole[:most]} - {1})
    for limit, most in ((0, 5), (5, 0)):
        with pytest.raises(ValueError):
            fitting.fit_all(s, raw, "q", limit, most, counter)
    with pytest.raises(contracts.ContractError, match="unknown_source"):
        fitting.fit_all(s, raw.withColumn("source_id", F.lit(9).cast("long")), "q", 14, 5, counter)
    assert chunking.limit_reached(raw, 1) and not chunking.limit_reached(raw, 100)


def test_split_place_against_all_places():
    rnd = random.Random(2)
    white = set(fitting.WHITE_SPACE)
    for _ in range(800):
        text = "".join(rnd.choice(["a", "é", "日", " ", "\n", "\r\n", "🙂", "bc"]) for _ in range(rnd.randint(0, 20)))
        sizes = [len(c.encode()) for c in text]
        total, at, places = sum(sizes), 0, []
        for k, size in enumerate(sizes[:-1]):
            at += size
            places.append((abs(at - total // 2), at, k + 1))
        near = [p for p in places if p[0] <= total // 4]
        lines = [p for p in near if text[p[2] - 1] == "\n"]
        blanks = [p for p in near if text[p[2] - 1] in white and text[p[2] - 1 : p[2] + 1] != "\r\n"]
        assert fitting.split_place(text) == (min(lines or blanks or places)[2] if places else None), repr(text)


def test_planner_with_a_counter():
    """A caller's counter that is the estimate itself plans as the estimate does."""
    rnd = random.Random(9)
    for _ in range(150):
        text = "".join(rnd.choice(["ab", "c ", "\n", "\n\n", "日", "é.", "x_1 "]) for _ in range(rnd.randint(0, 40)))
        c = chunking.ChunkConfig(rnd.randint(2, 8), 1, rnd.randint(1, 4), rnd.randint(4, 30))
        plain = [(a, b, k) for a, b, k, _ in chunking.plan(text, c)]
        assert [(a, b, k) for a, b, k, _ in chunking.plan(text, c, lambda x: chunking.Text(x).count(0, len(x)))] == plain


def test_many_spans_of_one_source(spark):
    """Fifty thousand spans of one source, each over its neighbours, in seconds."""
    n = 50_000
    spans = spark.range(n).selectExpr("0L AS source_id", "id * 10 AS start_byte", "id * 10 + 30 AS end_byte", "id")
    kept = suppress_overlaps(spans, [F.asc("id")])
    assert kept.count() == n // 2 and kept.where("id % 2 = 1").count() == 0


def test_ranks_over_a_flat_tree(spark):
    s = spark.range(500).selectExpr("id AS source_id", "concat('f', id % 97, '.txt') AS path", "10L AS len_bytes")
    got = tables.byte_budget(s, 1234).collect()
    want = sorted((r.path, r.source_id) for r in s.collect())[:123]
    assert sorted((r.path, r.source_id) for r in got) == want and max(r.cum_bytes for r in got) == 1230
    ranks = ranking.global_rank(s.select("source_id"), [F.desc("source_id")], "n").collect()
    assert all(r.n == 499 - r.source_id for r in ranks)


def test_corpora(spark, tmp_path):
    made = corpora.benchmark_corpus(spark, 7, 1000)
    rows = made.orderBy("source_id").collect()
    assert [len(r.text) for r in rows] == [143] * 6 + [142] and rows[3].path == "module-0003.rs" and all((corpora.TEMPLATE * 2).startswith(r.text) for r in rows)
    more = corpora.with_distractors(made, 130)
    assert more.count() == 137 and more.where("path = 'distractors/extra-0129.txt'").first().text.startswith("Field note 0129: ")
    want = hashlib.sha256()
    for r in rows:
        for part in (r.path.encode(), r.text.encode()):
            want.update(len(part).to_bytes(8, "big") + part)
    assert corpora.corpus_digest(made) == want.hexdigest()
    for wrong in (lambda: corpora.benchmark_corpus(spark, 5, 4), lambda: corpora.with_distractors(made, 3)):
        with pytest.raises(ValueError):
            wrong()
    f = tmp_path / "x"
    f.write_text("abc")
    assert not corpora.changed_on_disk(str(f), "abc") and corpora.changed_on_disk(str(f), "abd") and corpora.changed_on_disk(str(tmp_path / "y"), "")


REGISTRY = """format_version = 1
[[profile]]
id = "tiny"
repository = "owner/name"
revision = "{rev}"
license = "x"
tokenizer_file = "tokenizer.json"
tokenizer_family = "bert-wordpiece"
tokenizer_pad_token_id = 0
max_pair_tokens = 256
max_query_tokens = 64
tokenizer_model_max_tokens = 512
model_type = "bert"
model_architecture = "A"
type_vocab_size = 2
runtime_family = "cpu"
runtime_wrapper_version = "1"
dynamic_loading = true
required_inputs = ["input_ids", "attention_mask"]
optional_inputs = ["token_type_ids"]
expected_output_count = 1
score_kind = "relevance_logit"
[[profile.artifact]]
kind = "onnx_model"
path = "model.onnx"
sha256 = "{sha}"
size_bytes = 3
"""


def test_registry(tmp_path, capsys):
    text = REGISTRY.format(rev="a" * 40, sha=hashlib.sha256(b"abc").hexdigest())
    for old, new, said in (
        ('"tiny"', '"No"', "id must"), ("a" * 40, "a" * 39, "revision"), ("max_query_tokens = 64", "max_query_tokens = 300", "above max_pair"), ('"model.onnx"', '"../m"', "safe relative"),
        ('"bert"', '"xlm-roberta"', "go together"), ('["input_ids", "attention_mask"]', '["input_ids"]', "required"), ("size_bytes = 3", "size_bytes = 0", "size"), ("format_version = 1", "format_version = 2", "format_version"),
        ('kind = "onnx_model"', 'kind = "tokenizer"', "one onnx_model"), ("= true", "=", "not TOML"),
    ):
        with pytest.raises(models.RegistryError, match=said):
            models.parse(text.replace(old, new))
    profiles = models.parse(text)
    p = profiles["tiny"]
    assert models.graph_problems(p, ["input_ids", "attention_mask"], ["logits"]) == [] and len(models.graph_problems(p, ["input_ids", "x"], [])) == 3
    registry = tmp_path / "r.toml"
    registry.write_text(text)
    options = ["--registry", str(registry), "--cache-dir", str(tmp_path)]
    assert cli.main(["model", "verify", "tiny", *options]) == 2 and cli.main(["doctor", *options]) == 1
    folder = tmp_path / "tiny" / ("a" * 40)
    folder.mkdir(parents=True)
    (folder / "model.onnx").write_bytes(b"abd")
    assert models.verify(p, str(folder)) == ["model.onnx"]
    (folder / "model.onnx").write_bytes(b"abc")
    assert models.resolve("tiny", profiles, str(tmp_path))[0] == str(folder) and cli.main(["model", "verify", "tiny", *options]) == 0
    capsys.readouterr()
    assert cli.main(["model", "list", "--json", *options]) == 0 and json.loads(capsys.readouterr().out)["profiles"][0]["installed"] is True
    assert cli.main(["doctor", "--json", *options]) == 0 and json.loads(capsys.readouterr().out)["checks"][-1]["ready"] is True
    with pytest.raises(models.RegistryError):
        models.resolve("absent", profiles, str(tmp_path))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("alpha beta\n")
    (tmp_path / "b.txt").write_text("gamma\n")
    (tmp_path / "c.txt").write_bytes(b"\0")
    assert cli.main(["alpha", str(tmp_path), "--lexical", "--json"]) == 0
    doc = json.loads(capsys.readouterr().out)
    assert [r["path"] for r in doc["results"]] == ["a.txt"] and doc["results"][0]["snippet"] == "alpha beta\n"
    assert doc["stats"]["files_accepted"] == 2 and doc["stats"]["policy_exclusions_observed"] == 1 and set(doc["stats"]["timing"]) >= {"discovery", "chunking", "search"}
    assert {d["kind"] for d in doc["diagnostics"]} == {"nul_byte"}
    assert cli.main(["absent", str(tmp_path), "--lexical"]) == 1 and cli.main(["alpha", str(tmp_path), "--lexical", "--max-chunks", "1"]) == 3
    for wrong in (["x", "--lexical", "--batch-size", "2"], ["x", "--deep", "--candidates", "3", "--model", "m"], ["x"], ["x", "--lexical", "--top-k", "0"], ["x", str(tmp_path / "no"), "--lexical"]):
        assert cli.main(wrong) == 2
    assert cli.main([]) == 0


def test_global_and_repository_rules(tmp_path, monkeypatch):
    home, repo = tmp_path / "home", tmp_path / "repo"
    (home / "git").mkdir(parents=True)
    (repo / ".git" / "info").mkdir(parents=True)
    (home / "git" / "ignore").write_text("*.glob\n")
    (repo / ".git" / "info" / "exclude").write_text("*.excl\n")
    (repo / ".gitignore").write_text("!kept.glob\n")
    for name in ("a.glob", "kept.glob", "b.excl", "c.txt"):
        (repo / name).write_text("x")
    (repo / "sub").mkdir()
    (repo / "sub" / ".ignore").mkdir()  # there, and not readable as a file
    (repo / "sub" / "d.txt").write_text("x")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(home))
    monkeypatch.setenv("HOME", str(tmp_path))
    got = tree.listing(str(repo))
    assert [f.rsplit("/", 1)[1] for f in got.files] == ["c.txt", "kept.glob", "d.txt"]
    assert [k for k, *_ in got.diagnostics if k == "ignore_rule_failure"] == ["ignore_rule_failure"]


def test_scores_are_counted(spark):
    class Short:
        def score_batch(self, query, passages):
            return [1.0] * (len(passages) - 1)

    c = chunks(spark, [(0, "p", 0, 1, "a"), (0, "p", 1, 2, "b")])
    with pytest.raises(Exception, match="scores for"):
        scoring.score(c, "q", Short(), 2).collect()
    with pytest.raises(ValueError):
        scoring.score(c, "q", Short(), 0)


def test_benchmark_summary(spark, tmp_path):
    runs = spark.createDataFrame([(k, float(10 * k), None if k == 2 else 1.0) for k in range(1, 6)], "run int, wall_ms double, load_ms double")
    got = {r.measure: (r.n, r.lo, r.hi) for r in evaluate.benchmark_summary(runs, ["wall_ms", "load_ms"]).collect()}
    assert got == {"wall_ms": (4, 20.0, 50.0), "load_ms": (3, 1.0, 1.0)}
    f = tmp_path / "x.jsonl"
    f.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert evaluate.read_jsonl(spark, str(f), "a int").count() == 2
    f.write_text("")
    with pytest.raises(contracts.ContractError):
        evaluate.read_jsonl(spark, str(f), "a int")


def test_shared_folder_is_never_local_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_folder(Session())
