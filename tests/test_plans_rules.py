import itertools
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from thermofleet.decisions import backfill as b
from thermofleet.operators import lookup as lk
from thermofleet.plans import comfort as c
from thermofleet.plans import options as o
from thermofleet.plans import scoring as s
from thermofleet.rules import cooldown as cd
from thermofleet.rules import health as h
from thermofleet.rules import overrides as ov

SCHEDULE = "site_id bigint, sensor string, label string, seq int, start_hour int, end_hour int, pref_lo double, pref_hi double, acc_lo double, acc_hi double, backup_lo double, backup_hi double, cold_penalty double, hot_penalty double"


def now():
    return F.lit(at(600)).cast("timestamp")



def schedule(spark):
    return spark.createDataFrame([(1, "a", "a", 0, 0, 24, 68.0, 72.0, 66.0, 74.0, 60.0, 80.0, 2.0, 1.0)], SCHEDULE)


def test_comfort_cost_weights_and_rails(spark):
    p = spark.createDataFrame([(1, 0, "a", 12, 67.0), (1, 0, "a", 24, 65.0), (1, 0, "a", 144, 0.0), (1, 1, "a", 12, 70.0), (1, 1, "zz", 12, 0.0)], "site_id bigint, plan_id bigint, sensor string, step int, temp double")
    got = dict(rows(c.comfort_cost(p, schedule(spark), F.lit(10)), "plan_id", "comfort_cost"))
    assert got[0] == pytest.approx(1 * 2 * 1.0 + (9 * 2 + 1 * 2 * 3) * 0.83)
    assert got[1] == 0.0


def test_profile_away_widens_and_shifts(spark):
    profile = spark.createDataFrame([(1, -3.0, 6.0, -3.0, 2.0, 1.0)], "site_id bigint, preferred_offset double, preferred_widen double, min_offset double, max_offset double, penalty_scale double")
    r = c.apply_profile(schedule(spark), profile).first()
    assert (r.pref_lo, r.pref_hi, r.acc_lo, r.acc_hi, r.backup_hi) == (62.0, 72.0, 63.0, 76.0, 82.0)


@pytest.mark.parametrize(("outdoor", "sun", "weight", "want"), [(30.0, 0.0, 1.0, 1.0), (-200.0, 0.0, 1.0, 2.0), (70.0, 0.0, 1.0, -1.0), (50.0, 0.0, 3.0, 0.0), (30.0, 0.0, 0.0, 0.0), (30.0, 0.8, 1.0, 0.8)])
def test_radiant_offset(spark, outdoor, sun, weight, want):
    col = c.radiant_offset(F.lit(outdoor), F.lit(5.0), F.lit(sun), F.lit(1.0), F.lit(weight), 0.05, 50.0, 2.0, 1.0)
    assert spark.range(1).select(col).first()[0] == pytest.approx(want)


EFFECTORS = "site_id bigint, name string, control_type string, supported_modes array<string>, depends_on array<string>, energy_cost map<string,double>, proportional_band double, temp_sensor string"


def house(spark):
    return spark.createDataFrame(
        [(1, "t1", "trajectory", ["off", "heating"], [], {"": 1.0}, 1.0, "a"), (1, "t2", "trajectory", ["off", "heating"], [], {"": 2.0}, 1.0, "b"),
         (1, "fan", "binary", ["off", "low", "high"], ["t1", "t2"], {"low": 0.1, "high": 0.2}, 1.0, None)], EFFECTORS)


def test_options_cap_durations_and_respect_blocking(spark):
    free = o.timed_options(house(spark))
    assert free.filter("effector = 't1'").count() == 10
    assert free.agg(F.max(F.col("delay_steps") + F.col("duration_steps"))).first()[0] == 72
    held = o.timed_options(house(spark), spark.createDataFrame([(1, "t1")], "site_id bigint, effector string"))
    assert rows(held.filter("effector = 't1'"), "mode") == [("off",)]


def test_dependents_need_all_parents_from_the_start(spark):
    e = house(spark)
    plans = o.expand_plans(o.timed_options(e), e.filter(F.size("depends_on") > 0))
    per = plans.groupBy("plan_id").agg(F.max(F.when(F.col("effector") == "fan", F.col("mode"))).alias("fan"),
                                       F.count_if((F.col("effector") != "fan") & (F.col("mode") != "off") & (F.col("delay_steps") == 0)).alias("on"), F.count(F.lit(1)).alias("n"))
    assert per.filter("n <> 3").count() == 0
    assert per.filter("fan <> 'off' and on < 2").count() == 0
    assert per.count() == 100 + 9 * 2
    assert plans.filter("plan_id = 0 and mode <> 'off'").count() == 0


def test_greedy_target_merge(spark):
    df = spark.createDataFrame([([70.0, 68.0, 68.4, 68.6, 69.2, 70.0],)], "t array<double>")
    assert df.select(o.merge_targets(F.col("t"))).first()[0] == [68.0, 68.6, 69.2, 70.0]


def test_energy_of_each_kind(spark):
    e = spark.createDataFrame([(1, "t", "trajectory", [], [], {"": 1.0}, 1.0, None), (1, "r", "regulating", [], [], {"": 2.0}, 2.0, "a"), (1, "b", "binary", [], [], {"low": 0.5}, 1.0, None)], EFFECTORS)
    opt = spark.createDataFrame([(1, 1, "t", "heating", None, 24, None), (1, 2, "r", "heat", 71.0, 0, 36), (1, 3, "r", "heat", None, 0, 72), (1, 4, "b", "low", None, 0, 72), (1, 5, "t", "off", None, 0, None), (1, 6, "x", "on", None, 0, 72)],
                                "site_id bigint, plan_id bigint, effector string, mode string, target double, delay_steps int, duration_steps int")
    current = spark.createDataFrame([(1, "a", 70.0)], "site_id bigint, sensor string, temp double")
    got = dict(rows(s.plan_energy(opt, e, current), "plan_id", "energy_cost"))
    assert got == pytest.approx({1: 48 / 72, 2: 2 * 0.5 * 0.5, 3: 1.0, 4: 0.5, 5: 0.0, 6: 0.0})


def test_additive_predictions_equal_direct_sum(spark):
    rnd = random.Random(1)
    opts = [(1, p, f"e{i}", rnd.randrange(3)) for p in range(20) for i in range(3)]
    base = {("a", 12): 60.0, ("b", 24): 70.0}
    marg = {(f"e{i}", k, *key): rnd.random() for i in range(3) for k in (1, 2) for key in base}
    out = s.additive_predictions(
        spark.createDataFrame(opts, "site_id bigint, plan_id bigint, effector string, option_no bigint"),
        spark.createDataFrame([(1, *k, t) for k, t in base.items()], "site_id bigint, sensor string, step int, base_temp double"),
        spark.createDataFrame([(1, *k, d) for k, d in marg.items()], "site_id bigint, effector string, option_no bigint, sensor string, step int, delta double"))
    for r in out.collect():
        want = base[(r.sensor, r.step)] + sum(marg.get((e, n, r.sensor, r.step), 0.0) for _, p, e, n in opts if p == r.plan_id)
        assert r.temp == pytest.approx(want)


def test_advisory_counts(spark):
    d = spark.createDataFrame([(1, "w1", True), (1, "w2", False), (1, "w3", False)], "site_id bigint, device string, is_active boolean").withColumns({"open_action": F.lit("open"), "close_action": F.lit("close")})
    effect = spark.createDataFrame([(1, "w1"), (1, "w2")], "site_id bigint, device string")
    opts = o.advisory_options(d, [effect])
    assert rows(opts.groupBy("device").count()) == [("w1", 5), ("w2", 4)]
    assert rows(o.coarse_advisory(opts).filter("action <> 'hold'"), "device", "transition_step", "return_step") == [("w1", 0, None), ("w2", 0, 12)]
    for grid, combos in (("full", 20), ("coarse", 4), ("hold", 1)):
        out = o.cross_advisory(opts, F.lit(grid))
        assert {r.grid for r in out.collect()} == {grid} and out.select("combo_id").distinct().count() == combos


def test_every_site_gets_all_combinations(spark, tmp_path):
    """The registered grids leave out no site and no combination, whatever the site's number."""
    import itertools

    import __spark_entry__ as entry

    data = [(k * 5 + d, site, "P" if d < 2 else "O") for k, site in enumerate((1, 2, 7, 9, 64)) for d in range(1, 4)]
    spark.createDataFrame(data, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    hold = ("hold", 0, None)
    full = {"P": [hold, *[("close", x, None) for x in (0, 12, 24, 36)]], "O": [hold, *[("open", 0, x) for x in (12, 24, 36)]]}
    coarse = {"P": [hold, ("close", 0, None)], "O": [hold, ("open", 0, 12)]}
    for name, options in (("advisory_cross_full", full), ("advisory_cross_coarse", coarse)):
        found = {}
        for r in entry.queries()[name](spark, str(tmp_path)).collect():
            found.setdefault(r.site_id, {}).setdefault(r.combo_id, {})[r.device] = (r.action, r.transition_step, r.return_step)
        assert sorted(found) == sorted({site for _, site, _ in data})
        for site, combos in found.items():
            devices = sorted((f"d{key % 5}", status) for key, owner, status in data if owner == site)
            want = {tuple(zip([d for d, _ in devices], c, strict=True)) for c in itertools.product(*[options[status] for _, status in devices])}
            assert len(combos) == len(want) and {tuple(sorted(c.items())) for c in combos.values()} == want


def test_envelope_rules(spark):
    p = spark.createDataFrame([(1, "a", 12, x) for x in (70.0, 71.0, 120.0)] + [(1, "b", 12, x) for x in (70.0, 70.5)], "site_id bigint, sensor string, step int, temp double")
    current = spark.createDataFrame([(1, "a", 70.0), (1, "b", 60.0)], "site_id bigint, sensor string, temp double")
    assert rows(s.prediction_envelope(p, current), "sensor", "check", "severity") == [("a", "prediction_range_high", "error"), ("a", "prediction_spread", "warning"), ("b", "prediction_rate", "warning")]


def test_outcomes_and_status(spark):
    d = spark.createDataFrame([(1, at(0), {"a": {"1h": 70.0, "2h": 71.0, "6h": 72.0}}), (1, at(590), {"a": {"1h": 70.0}}), (1, at(-2_000), {"a": {"1h": 1.0}})], "site_id bigint, ts timestamp, predictions map<string,map<string,double>>")
    r = spark.createDataFrame([(1, at(69), "a", "69.5"), (1, at(131), "a", "60"), (1, at(360), "b", "1"), (1, at(361), "a", "50")], "site_id bigint, ts timestamp, name string, value string")
    found = b.match_outcomes(b.prediction_rows(d), r, now())
    # 9 minutes off counts, 11 does not; at six hours the nearest snapshot holds another sensor only
    assert rows(found, "horizon", "actual", "error") == [("1h", 69.5, 0.5)]
    status = {x.decision_ts: (x.settled, x.touched) for x in b.backfill_status(d, found, now()).collect()}
    assert status == {at(0): (True, True), at(590): (False, False), at(-2_000): (True, True)}


def check(spark, **kw):
    row = {"site_id": 1, "name": "c", "entity_id": "e", "min_value": 12.0, "max_value": None, "expected_state": None, "severity": "critical", "message": "", "when_entity": None, "when_state": None, "when_for_minutes": 0, "sustain_minutes": 15, "sustain_samples": 12}
    row.update(kw)
    types = "site_id bigint, name string, entity_id string, min_value double, max_value double, expected_state string, severity string, message string, when_entity string, when_state string, when_for_minutes int, sustain_minutes int, sustain_samples int"
    return spark.createDataFrame([tuple(row[t.split(" ")[0]] for t in types.split(", "))], types)


@pytest.mark.parametrize(("drop_minute", "fires"), [(3, True), (4, False)])
def test_sustained_twelve_of_fifteen(spark, drop_minute, fires):
    history = spark.createDataFrame([(1, "e", at(500), "14"), (1, "e", at(585 + drop_minute), "12")], "site_id bigint, entity_id string, changed_at timestamp, state string")
    current = spark.createDataFrame([(1, "e", "12", at(590))], "site_id bigint, entity_id string, state string, last_changed timestamp")
    assert (h.health_alerts(check(spark), current, now(), history).count() == 1) is fires


def test_samples_before_the_first_state_do_not_count(spark):
    history = spark.createDataFrame([(1, "e", at(598), "1")], "site_id bigint, entity_id string, changed_at timestamp, state string")
    assert h.sustained_counts(check(spark), history, now()).first().n_violating == 2


def test_thresholds_are_inclusive_and_gone_entities_warn(spark):
    def alerts(state, **kw):
        current = spark.createDataFrame([(1, "e", state, at(0))], "site_id bigint, entity_id string, state string, last_changed timestamp")
        return rows(h.health_alerts(check(spark, sustain_minutes=0, **kw), current, now()), "key", "severity")

    assert alerts("12") == [("c_fault", "critical")] and alerts("12.1") == []
    assert alerts("30", min_value=None, max_value=30.0) == [("c_fault", "critical")]
    assert alerts("unavailable") == [("c_unavailable", "warning")]
    assert alerts("off", expected_state="on") == [("c_fault", "critical")] and alerts("on", expected_state="on") == []
    assert alerts("12", when_entity="other", when_state="on") == []


@pytest.mark.parametrize(("seed", "ranges"), [(1, 4), (2, 16)])
def test_cooldown_equals_greedy_scan(spark, seed, ranges):
    """Also cut into many ranges, so that what one range leaves silent reaches into the next ones."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(ranges < 5).lower())
    rnd = random.Random(seed)
    data = [(rnd.randrange(2), at(rnd.randrange(20_000) / 7), i) for i in range(300)]
    out = cd.cooldown_scan(spark.createDataFrame(data, "k bigint, raised_at timestamp, id bigint"), ["k"], 3_600, tie=["id"])
    got = {r.id for r in out.filter("sent").collect()}
    for k, v in kept.items():
        spark.conf.set(k, v)
    want = set()
    for k in (0, 1):
        last = None
        for _, ts, i in sorted([d for d in data if d[0] == k], key=lambda d: (d[1], d[2])):
            if last is None or ts - last >= timedelta(hours=1):
                want.add(i)
                last = ts
    assert got == want and out.count() == 300


def test_notification_gate(spark):
    f = spark.createDataFrame([(1, "a", "open", -1.4), (1, "b", "open", -1.5), (1, "c", "open", -3.0), (1, "d", "open", -3.0)], "site_id bigint, device string, action string, cost_delta double")
    sent = spark.createDataFrame([(1, "c", at(599)), (1, "d", at(600 - 240))], "site_id bigint, device string, sent_at timestamp")
    assert rows(cd.notification_gate(f, F.lit(12), sent, now()), "device") == [("b",), ("d",)]
    assert cd.notification_gate(f, F.lit(23), sent, now()).count() == 0


def test_override_classes(spark):
    keys = "site_id bigint, device string"
    desired = spark.createDataFrame([(1, "ok", "trajectory", None, 70.0), (1, "moved", "trajectory", None, 70.0), (1, "old", "trajectory", None, 70.0), (1, "none", "trajectory", None, None), (1, "r", "regulating", "heat", 70.0), (1, "b", "binary", "low", None)], keys + ", control_type string, mode string, target double")
    seen = spark.createDataFrame([(1, "ok", None, 70.4), (1, "moved", None, 65.0), (1, "old", None, 65.0), (1, "r", "heat", 70.0), (1, "b", "high", None)], keys + ", mode string, target double")
    last = spark.createDataFrame([(1, "moved", None, 68.0, at(590)), (1, "old", None, 68.0, at(569)), (1, "b", "off", None, at(590))], keys + ", mode string, target double, at timestamp")
    out = ov.classify_devices(desired, seen, last, now())
    assert dict(rows(out, "device", "result")) == {"ok": "already_correct", "moved": "override", "old": "applied", "none": "ineligible", "r": "already_correct", "b": "override"}
    kept = ov.next_applied(out, last, now())
    assert {r.device: r["at"] for r in kept.collect()}["old"] == at(600)
    assert dict(rows(ov.classify_devices(desired, seen, last, now(), force=True), "device", "result"))["moved"] == "applied"
    assert sum(r.n for r in ov.result_counts(out).collect()) == 6


def test_combinations_are_unfolded_without_lists_per_combination(spark):
    """A row is made from a number and a list: nothing above the unfolding walks a key's owners for each combination."""
    opts = [(site, f"d{d}", k, f"a{k}") for site in (1, 2) for d in range(3) for k in range(d + 2)]
    df = spark.createDataFrame(opts, "site_id bigint, device string, option_no bigint, action string")
    out = lk.combination_table(df, ["site_id"], "device", "combo_id")
    want = sorted((site, i, f"d{d}", c[d], f"a{c[d]}") for site in (1, 2) for i, c in enumerate(itertools.product(range(2), range(3), range(4))) for d in range(3))
    assert rows(out, "site_id", "combo_id", "device", "option_no", "action") == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("RepartitionByExpression")]
    assert "lambdafunction" not in above
    wide = lk.combination_rows(df, ["site_id"], "device", "combo_id")
    assert rows(wide.select("site_id", "combo_id", F.explode("choices").alias("c")).select("site_id", "combo_id", "c.*")) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plans_with_dependents_equal_the_spelled_out_product(spark, seed):
    """Random houses, also with a parent that is no owner, two parents and dependents without `off`."""
    rnd = random.Random(seed)
    own = [(f"t{i}", "trajectory", ["off", "heating"], []) for i in range(2)] + [("b", "binary", ["off", "low"], [])]
    kids = [(f"k{i}", "binary", rnd.choice([["low", "off", "high"], ["high"], ["off", "low"]]), rnd.sample(["t0", "t1", "b", "gone"], rnd.choice([1, 2]))) for i in range(3)]
    e = spark.createDataFrame([(1, *x) for x in own + kids] + [(2, *own[0])], "site_id bigint, name string, control_type string, supported_modes array<string>, depends_on array<string>")
    options = o.timed_options(e)
    numbered = {}
    for r in o.option_numbers(options).collect():
        numbered.setdefault((r.site_id, r.effector), []).append((r.option_no, r["mode"], r.delay_steps))
    want = []
    for site, names, more in ((1, [x[0] for x in own], kids), (2, ["t0"], [])):
        names = sorted(names)
        per = 1
        for k in more:
            per *= len(k[2])
        for base, combo in enumerate(itertools.product(*[sorted(numbered[site, n]) for n in names])):
            on = {n for n, (_, mode, delay) in zip(names, combo, strict=True) if mode != "off" and delay == 0}
            lists = []
            for name, _, modes, parents in more:
                ordered = [m for m in modes if m == "off"] + [m for m in modes if m != "off"]
                free = ordered if set(parents) <= on else ["off"]
                lists.append([(name, ordered.index(m) if m in ordered else -1, m) for m in free])
            for i, extra in enumerate(itertools.product(*lists)):
                want += [(site, base * per + i, n, c[0], c[1]) for n, c in zip(names, combo, strict=True)]
                want += [(site, base * per + i, *x) for x in extra]
    plans = o.expand_plans(options, e.filter(F.size("depends_on") > 0))
    assert rows(plans, "site_id", "plan_id", "effector", "option_no", "mode") == sorted(want)


def test_plan_expansion_counts_without_sorting_rows(spark, sf):
    """Modes are numbers while they are aggregated; as strings every row would be sorted."""
    import __spark_entry__ as entry

    plan = entry.queries()["plan_expansion"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    top = plan[:plan.index("Generate")]
    assert "SortAggregate" not in top and top.count("HashAggregate") >= 4


def test_temperatures_of_many_plans_are_dealt_out(spark, monkeypatch):
    """Plans that unfold much are not merged into one task, and every cell is there, with and without an effect."""
    monkeypatch.setattr(s, "CELLS", 500, raising=False)
    options = [(site, plan, f"e{e}", (plan + e) % 3) for site in (1, 2, 3) for plan in range(60) for e in range(2)]
    base = [(site, f"s{k}", step, 60.0 + k + site) for site in (1, 2) for k in range(3) for step in (12, 24)]
    effect = {(site, f"e{e}", n, f"s{k}", 12): 0.25 * (site + e + n + k) for site in (1, 2, 3) for e in range(2) for n in (1, 2) for k in range(4)}
    out = s.additive_predictions(
        spark.createDataFrame(options, "site_id bigint, plan_id bigint, effector string, option_no bigint"),
        spark.createDataFrame(base, "site_id bigint, sensor string, step int, base_temp double"),
        spark.createDataFrame([(*k, v) for k, v in effect.items()], "site_id bigint, effector string, option_no bigint, sensor string, step int, delta double"))
    want = sorted((site, plan, sensor, step, temp + sum(effect.get((site, f"e{e}", (plan + e) % 3, sensor, step), 0.0) for e in range(2))) for site, sensor, step, temp in base for plan in range(60))
    assert rows(out, "site_id", "plan_id", "sensor", "step", "temp") == want
    assert sum(n > 0 for n in out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()) > 2
