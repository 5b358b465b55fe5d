"""Each operator against its plain version on messy rows, on the smallest tables, and on an empty table."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm import brute
from pyspark.sql import functions as F

from thermofleet.llm import components, lines, mixing, nearest, packing, quality, queries, scoring, shards, simhash, substrings, suffixes, tables


def same(df, columns, expected):
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    assert got == Counter(expected)


def digest2(found):
    return found.select("doc_id", "n_bytes", *queries._span_digest(found), F.sha2("kept", 256).alias("sha"))


def digest8(found):
    return found.select("doc_id", "n_words", queries._span_digest(found)[0], F.sha2("kept_text", 256).alias("sha"))


def test_suffix_dedup(docs, pairs, none):
    same(digest2(suffixes.without_repeats(docs)), "*", brute.suffix_dedup(pairs))
    assert digest2(suffixes.without_repeats(none)).count() == 0


def test_suffix_dedup_other_lengths(docs, pairs):
    same(digest2(suffixes.without_repeats(docs, 128)), "*", brute.suffix_dedup(pairs, 128))
    with pytest.raises(ValueError):
        suffixes.without_repeats(docs, 100)


def test_suffix_query(spark, sf, sf_pairs):
    same(queries.QUERIES["op2_suffix_dedup"](spark, sf), "*", brute.suffix_dedup(sf_pairs))


def test_substring_dedup(docs, pairs, none):
    same(digest8(substrings.without_repeats(docs)), "*", brute.word_dedup(pairs))
    same(digest8(substrings.without_repeats(docs, 6)), "*", brute.word_dedup(pairs, 6))
    assert substrings.without_repeats(none).count() == 0


def test_line_dedup(docs, pairs, none):
    kept = lines.without_lines(docs)
    assert kept.columns[:3] == ["doc_id", "text", "lang"]
    same(kept, ["doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)], brute.line_dedup(pairs))
    assert lines.without_lines(none).count() == 0


def test_line_runs_are_merged_by_levels(spark):
    held = lines.LineRuns(spark, fan_in=2)
    for k in range(5):
        batch = spark.createDataFrame([(k, x) for x in ("every", f"only{k}")], "doc_id long, line string").select("doc_id", lines.key_hash(F.col("line")).alias("h")).select("doc_id", "h.*")
        fresh = {r["fresh"] for r in held.add(batch).collect()}
        assert fresh == ({True} if k == 0 else {True, False})
    assert [len(level) for level in held.levels] == [1, 0, 1]
    assert [tuple(r)[2:] for r in held.repeated(5).collect()] == [(5, 4)]
    homes = [r["a"] for run in held.tables() for r in run.collect()]
    assert len(homes) == len(set(homes)) == 6  # every hash has one home, so the joins with the runs decide the counts
    held.levels[-1] = []
    assert held.repeated(1).count() == 1


def test_line_runs_do_not_move(spark):
    held = lines.LineRuns(spark, fan_in=9)
    batch = spark.createDataFrame([(1, 5, 6), (2, 7, 8)], "doc_id long, a long, b long")
    held.add(batch)
    merged = held._both(*[held.tables()[0]] * 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in merged


def test_line_runs_are_not_sent_to_every_task(docs, monkeypatch):
    """A run's stored size is a fraction of what it takes as a broadcast table: batches are merge-joined with it whatever its size."""
    plans = []
    monkeypatch.setattr(lines, "bucketed", lambda df, *how: plans.append(df._jdf.queryExecution().executedPlan().toString()) or tables.bucketed(df, *how))
    lines.dropped_keys(docs)
    met = [p for p in plans if "Join" in p]
    assert met and not [p for p in met if "BroadcastHashJoin" in p]


def test_line_dedup_with_hot_rows(spark):
    """A third of the rows without id, a third copies of one row."""
    line = "a line that is long enough to be dropped when many hold it"
    rows = [(None, f"{line}\nrow {k} of those without id, {k} times over and over") for k in range(40)]
    rows += [(7, f"{line}\nthe same again and again in every one of the copies")] * 40 + [(k, f"x{k}\n{line}") for k in range(10, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(lines.without_lines(df), ["doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)], brute.line_dedup(rows))
    dealt = [r["n"] for r in lines.line_hashes(df).groupBy("batch").agg(F.count("*").alias("n")).collect()]
    assert max(dealt) <= 2 * min(dealt)


def test_quality(docs, pairs, none):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    expected = brute.quality(pairs)
    same(quality.measured(docs), columns, expected)
    assert quality.measured(none).count() == 0
    same(quality.kept_documents(docs), ["doc_id"], [(r[0],) for r in expected if r[-1]])


def test_cascade_verdict_does_not_depend_on_the_order(docs):
    order = quality.cascade_order(docs)
    assert sorted(order) == sorted(quality.RULES)
    counts = {docs.where(quality.rejected_by(o).isNull()).count() for o in (order, order[::-1])}
    assert len(counts) == 1


def test_simhash_groups(docs, pairs, none):
    found = simhash.groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    expected = brute.simhash_groups(pairs)
    same(found, "*", expected)
    stay = {(d,) for d, _, c in expected if d == c}
    same(simhash.one_of_each(docs), ["doc_id"], stay)
    assert simhash.groups(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_one_of_each_group_whatever_the_ids(spark):
    """Texts without id, and several texts under one id, each have a row of their own group that stays."""
    texts = [" ".join(f"{w}{k}" for w in "a b c d e f g h i j k l m n o p".split()) for k in range(12)]
    rows = [(None, t) for t in texts[:5]] * 3 + [(None, None), (None, "")]  # groups without any id
    rows += [(7, texts[5]), (7, texts[6]), (7, texts[6])]  # one id, two groups
    rows += [(8, texts[7]), (9, texts[7]), (None, texts[7])]  # the smallest id stays
    rows += [(3, texts[8]), (9, texts[8]), (9, texts[9])]  # id 9 is another group's, and the only one of its own
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r["doc_id"], r["text"] or "") for r in simhash.one_of_each(df).collect())
    expected = [(None, ""), *[(None, t) for t in texts[:5]], (7, texts[5]), (7, texts[6]), (8, texts[7]), (3, texts[8]), (9, texts[9])]
    assert got == Counter(expected)


def test_links_of_close_fingerprints_are_whole(spark):
    """Chains of fingerprints four bits apart, and a ball of many: the components are those of all pairs."""
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(6):
        at = int(rng.integers(0, 1 << 63))
        for _ in range(40):
            fps.add(at)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                at ^= 1 << int(b)
    ball = int(rng.integers(0, 1 << 63))
    for _ in range(150):
        fps.add(ball ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = {np.int64(r["node"]).view(np.uint64).item(): r["root"] for r in components.connected(simhash.links(df)).collect()}
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    ours, theirs = defaultdict(set), defaultdict(set)
    for f in fps:
        ours[roots.get(f, f)].add(f)
        theirs[find(f)].add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("whole", [simhash.groups, simhash.one_of_each])
def test_exploded_keys_are_not_sent_to_every_task(spark, docs, monkeypatch, whole):
    """An exploded table counts as small as the table before, so the joins on its keys must not be left to that size."""
    plans = []

    def held(df, label, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.stored(df, label, **more)

    monkeypatch.setattr(simhash, "stored", held)
    monkeypatch.setattr(components, "stored", held)
    whole(docs)
    joins = [j for p in plans for j in re.findall(r"(\w+Join) \[key#", p)]
    assert joins and set(joins) == {"SortMergeJoin"}  # with pivots, with key labels, with probes


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = dict(tuple(r) for r in components.connected(edges).collect())
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_packing(docs, pairs, none):
    path = queries.tokenizer_path()
    got = packing.packed_documents(docs, path, 64).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    expected = Counter((d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for d, t in pairs)
    joined = defaultdict(list)
    for r in sorted(got, key=lambda r: r["start"]):
        joined[r["doc_id"]].append(r)
    lengths = Counter()
    for (doc, ids), n in expected.items():
        for a in range(0, len(ids), 64):
            lengths[doc, a // 64, a, ids[a:a + 64]] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == lengths
    places = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) == brute.best_fit_sequences([r["length"] for r in got], 64)
    assert packing.packed_documents(none, path).count() == 0


def test_best_fit_plan_equals_best_fit_one_by_one():
    rng = np.random.default_rng(1)
    for size in (1, 7, 64, 100):
        for _ in range(20):
            lengths = rng.integers(1, size + 1, int(rng.integers(1, 200))).tolist()
            made, plan = set(), packing.best_fit_plan(Counter(lengths), size)
            for length, number, per, first, _ in plan:
                nexts = [n for le, n, *_ in plan if le == length and n > number] + [Counter(lengths)[length]]
                made |= {first + k // per for k in range(min(nexts) - number)}
            assert len(made) == brute.best_fit_sequences(lengths, size)


def test_scores(docs, pairs, none):
    got = scoring.scored(docs).collect()
    expected = brute.base_scores(pairs)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 6))
    assert sorted(map(key, got)) == sorted(map(key, expected))
    assert all(np.isfinite(r["score"]) for r in got)
    assert scoring.scored(none).count() == 0


def test_automaton_sums_to_one_and_failure_arcs_agree():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.02, (64, 64, 64))
    counts[:, :, scoring.BEGIN] = 0
    automaton = scoring.BackoffAutomaton(counts)
    after, logs = automaton.closed()
    for state in range(0, len(automaton.histories), 37):
        row = logs[state * 64:state * 64 + 63]
        assert abs(sum(10 ** x for x in row) - 1) < 1e-9
        for symbol in (0, 17, scoring.END):
            to, value = automaton.step(state, symbol)
            assert (to * 64, value) == (after[state * 64 + symbol], logs[state * 64 + symbol])


def test_model_beats_single_words_on_held_out_texts(spark, sf):
    got = scoring.scored(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scores_know_the_order_of_words(spark):
    """Two words of one class: only their pairs with the next word tell them apart."""
    trains = [k for k in range(400) if not scoring.held_out(k)][:200]
    held = [k for k in range(400) if scoring.held_out(k)][:2]
    rows = [(k, "the redxyz catxyz . the bluxyz dogxyz .") for k in trains]
    rows += [(held[0], "the redxyz catxyz ."), (held[1], "the redxyz dogxyz ."), (held[0], ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_tokens"]): r for r in scoring.scored(df).collect()}
    right, crossed = got[held[0], 5], got[held[1], 5]
    assert abs(right["base_score"] - crossed["base_score"]) < 1e-9
    assert right["score"] > crossed["score"] + 1

    # the same by hand: pair counts over the class automaton
    tokens = {k: (t or "").split() for k, (_, t) in enumerate(rows)}
    train = [tokens[k] for k, (d, _) in enumerate(rows) if not scoring.held_out(d)]
    ones, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<", *t], [*t, ">"], strict=True))
    kinds = {w: int(scoring._Tokens([1], [w.encode()]).classes[0]) for w in ones}
    counts = np.zeros((64, 64, 64))
    for t in train:
        seq = [scoring.BEGIN, scoring.BEGIN, *[kinds[w] for w in t], scoring.END]
        for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
            counts[a, b, c] += 1
    model, size = scoring.BackoffAutomaton(counts), Counter(kinds[w] for w in ones)
    tokens_of = Counter(kinds[w] for t in train for w in t)
    ones["<"] = len(train)
    for (d, n), r in got.items():
        words = next(tokens[k] for k, (e, _) in enumerate(rows) if e == d and len(tokens[k]) + 1 == n)
        state, total = model.start() // 64, 0.0
        for a, b in zip(["<", *words], [*words, ">"], strict=True):
            kind = kinds.get(b, scoring.END)
            state, log = model.step(state, kind)
            share = 1.0 if b == ">" else (ones[b] + 0.5) / (tokens_of[kind] + 0.5 * (size[kind] + 1))
            total += np.log10((pairs[a, b] + scoring.PRIOR * 10 ** log * share) / (ones[a] + scoring.PRIOR))
        assert abs(total - r["score"]) < 1e-6


def test_shards(docs, pairs, none):
    got = shards.sharded(docs, 5).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len((t or "").encode()) + 8) for d, t in pairs)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.sharded(none).count() == 0


def test_shard_maps_are_edited_only_where_needed(spark):
    rng = np.random.default_rng(4)
    sizes = spark.createDataFrame([(k, int(rng.integers(1, 1_000)), 1) for k in range(400)], "virtual_slot int, bytes long, n_rows long")
    first = shards.first_map(sizes, 6, 400)
    loads = lambda m: {r[0]: r[1] for r in m.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("bytes")).collect()}
    even = loads(first)
    assert len(even) == 6 and max(even.values()) - min(even.values()) < 1_000
    more = {r["virtual_slot"]: r["shard"] for r in shards.grown(first, sizes, 6).collect()}
    before = {r["virtual_slot"]: r["shard"] for r in first.collect()}
    assert {more[s] for s in more if more[s] != before[s]} == {6}
    fed = sizes.withColumn("bytes", F.when(F.col("virtual_slot") % 7 == 0, F.col("bytes") * 9).otherwise(F.col("bytes")))
    after = shards.rebalanced(first, fed, 6)
    moved = [r for r in after.collect() if before[r["virtual_slot"]] != r["shard"]]
    load = sorted(r[1] for r in after.join(fed, "virtual_slot").groupBy("shard").agg(F.sum("bytes")).collect())
    was = sorted(r[1] for r in first.join(fed, "virtual_slot").groupBy("shard").agg(F.sum("bytes")).collect())
    assert load[-1] - load[0] <= was[-1] - was[0] and len(moved) < 200
    assert {r["version"] for r in after.collect()} == {1}


def vectors(seed=6, n=900):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(n)]
    rows += [(n + k, rows[3][1]) for k in range(400)]
    rows += [(2_000, None), (2_100, [float("nan")] * 8), (2_200, [None] * 8), (None, [1.0] * 8), (2_300, [0.5, 0.5]), (2_400, [0.0] * 8), (2_400, [1.0] * 8)]
    return rows


def test_top_k(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, v string, page string").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 2_400]
    got = nearest.top_k(df.where("vec_id is null or vec_id <> 2400"), df.where("vec_id % 100 = 0 and vec_id <> 2400"))
    same(got, "*", brute.top_k(exact))
    assert {r["vec_id"] for r in nearest.top_k(df, df.where("vec_id = 2400")).collect()} & {2_400} == set()
    assert nearest.top_k(df.limit(0), df.limit(0)).count() == 0


def test_mix(docs, rows, none):
    got = mixing.mixed(docs, max_repeats=3.0).collect()
    tokens, n = Counter(), Counter()
    for _, t, _, s in rows:
        tokens[s] += len(brute.words(t))
        n[s] += 1
    shown = defaultdict(list)
    for r in got:
        shown[r["source"]].append(r)
        assert 0 <= r["mix_at"] <= 1
    most = max(tokens.values())
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        rate = [(t / most) ** (mid - 1) for t in tokens.values() if t]
        lo, hi = (mid, hi) if max(rate) > 3.0 else (lo, mid)
    for s, own in shown.items():
        blocks = (tokens[s] / most) ** (hi - 1)
        count = Counter(r["block"] for r in own)
        assert all(count[b] == n[s] for b in range(int(blocks + 1e-6)))
        used = sum(r["tokens"] for r in own if r["block"] == int(blocks + 1e-6))
        assert used <= (blocks - int(blocks + 1e-6)) * tokens[s] + 1
    assert set(shown) == set(tokens)
    assert mixing.mixed(none).count() == 0


def test_mix_to_an_entropy(spark):
    sources = spark.createDataFrame([("a", 900, 9), ("b", 90, 9), ("c", 10, 9)], "source string, tokens long, n_rows long")
    alpha = mixing.exponent(sources, target_entropy=0.9)
    w = np.array([0.9, 0.09, 0.01]) ** alpha
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 0.9) < 1e-6


def test_mixed_documents_keep_columns_and_repeat_rows(docs, rows, none):
    got = mixing.mixed_documents(docs, max_repeats=3.0)
    assert got.columns == docs.columns
    counts = Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect())
    assert set(counts) == {(d, t, s) for d, t, _, s in rows} and max(counts.values()) >= 2
    assert mixing.mixed_documents(none).count() == 0


def hot_rows():
    """A third of the rows without id, a third copies of one row, and the rest."""
    return [(None, f"row {k} of those without an id " + "word " * (k % 50)) for k in range(300)] + [(7, "the same text again and again " * 5)] * 300 + [(k, f"x{k} " * 20) for k in range(10, 310)]


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in hot_rows()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_hot_rows_are_sharded_evenly(hot):
    rows = shards.sharded(hot, shards=6).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert len(rows) == 900 and max(size.values()) <= 1.05 * min(size.values())
    for shard in size:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, len(t.encode()) + 8) for d, t in hot_rows())
    slots = Counter(r["virtual_slot"] for r in rows if r["doc_id"] == 7)
    assert max(slots.values()) <= 6


def test_hot_rows_are_mixed_and_packed(hot):
    again = mixing.mixed_documents(hot, max_repeats=1.0)
    assert Counter((r["doc_id"], r["text"]) for r in again.collect()) == Counter(hot_rows())
    packed = packing.packed_documents(hot, queries.tokenizer_path(), 256).collect()
    assert len(packed) >= 900 and Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(d for d, _ in hot_rows())
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
