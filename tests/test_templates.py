"""Template mining: groups that fail are split, and the dictionary does not grow with the variables."""

from collections import defaultdict

from blockwatch.operators import templates as TP


def _mine(spark, contents, **kw):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "line_no long, content string").repartition(3)
    return {r["line_no"]: r["template"] for r in TP.mine_templates(df, **kw).collect()}


def _plain(contents, st, rounds):
    """The rule, line by line in Python."""
    import re
    lines = []
    for c in contents:
        c = re.sub(r"(/|)([0-9]+\.){3}[0-9]+(:[0-9]+|)(:|)", "<*>", c or "")
        lines.append(tuple("<*>" if re.search("[0-9]", t) else t for t in re.split("[ \t\n\r\f]+", c) if t))
    groups, out = defaultdict(set), {}
    for t in set(lines):
        if t:
            groups[(len(t), *(t + ("", ""))[:2])].add(t)
        else:
            out[t] = ""
    for k in range(rounds):
        nxt = defaultdict(set)
        for g, own in groups.items():
            values = [sorted({t[i] for t in own}) for i in range(len(next(iter(own))))]
            if sum(len(v) == 1 for v in values) / len(values) >= st:
                out |= dict.fromkeys(own, " ".join(v[0] if len(v) == 1 else "<*>" for v in values))
                continue
            at = min((len(v), i) for i, v in enumerate(values) if len(v) > 1)[1]
            for t in own:
                nxt[(g, at, t[at])].add(t)
        groups = nxt
    for own in groups.values():
        out |= {t: " ".join(t) for t in own}
    return {i: out[t] for i, t in enumerate(lines)}


def _word(i):
    return "v" + "".join(chr(97 + int(d)) for d in str(i))  # a variable without a digit


def test_two_shapes_of_equal_length_and_lead(spark):
    def lines(n):
        return [f"node state {'up' if i % 2 else 'down'} {'by ' + _word(i) if i % 2 else _word(i) + ' reason'} in rack" for i in range(n)]
    want = {"node state up by <*> in rack", "node state down <*> reason in rack"}
    for n in (60, 600):  # flat, however many variables there are
        assert set(_mine(spark, lines(n)).values()) == want


def test_against_the_plain_rule(spark):
    import random
    rng = random.Random(6)
    shapes = ["link {a} error on {b} port", "link {a} error off {b} port", "job {b} of user {c} ended {a} now", "job {b} by user {c} ended {a} now",
              "{a} {b} {c}", "x", "", None, "10.0.0.1:80 up 7 days", "link {a} error on {b} card", "job done"]
    contents = [None if s is None else s.format(a=_word(rng.randint(0, 40)), b=_word(rng.randint(0, 3)), c=_word(rng.randint(0, 9)))
                for s in (rng.choice(shapes) for _ in range(500))]
    contents += ["  link\t va   error  on vb port ", "link va error on vb port"]
    for st, rounds in ((0.8, TP.DEFAULT_ROUNDS), (0.6, 2), (1.0, 1)):
        got = _mine(spark, contents, st=st, rounds=rounds)
        want = _plain(contents, st, rounds)
        # A null line has no tokens, so an empty template.
        assert {i: t or "" for i, t in got.items()} == want


def test_empty(spark):
    assert _mine(spark, []) == {}
    assert _mine(spark, ["", "  "]) == {0: "", 1: ""}


def test_large_groups_by_all_partitions(spark, monkeypatch):
    """Groups over the size of a partition give the same templates as small ones."""
    monkeypatch.setattr(TP, "PART_TOKENS", 40)
    contents = [f"link {_word(i % 30)} error on {_word(i % 7)} port {_word(i % 2)}" for i in range(300)]
    contents += [f"job {_word(i)} ended" for i in range(9)] + ["x", "10.0.0.1:80 up 7 days"]
    for st, rounds in ((0.8, TP.DEFAULT_ROUNDS), (0.6, 2)):
        assert _mine(spark, contents, st=st, rounds=rounds) == _plain(contents, st, rounds)


def test_tokens_are_not_shuffled(spark):
    """A round deals the open lines out once: no exchange stands between the tokens of a line and the
    facts of its group (their shuffles took the disk)."""
    lines = spark.createDataFrame([(f"a {_word(i)} c", "a") for i in range(50)], "_bw_m string, g string").select(
        "_bw_m", TP._digest("g").alias("_bw_g")).checkpoint()
    rows = TP._with_facts(lines, 0.8)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert "Generate" in plan
    above = plan.split("Generate")[0]
    # The only exchange above the tokens is that of the lines, on the other side of the join.
    assert above.count("Exchange hashpartitioning") <= 1 and "MapInArrow" not in plan
    assert plan.count("Exchange hashpartitioning") + plan.count("ReusedExchange") <= 2
