from carelake.operators.windows import recognition


def test_sets_ranks_recoveries_and_empty_cases(spark):
    rows = [
        ("a", ["x", "y"], ["x", "z"], False, 10), ("a", ["p", "q", "x"], ["x"], False, 20), ("a", [], ["x"], True, 30), ("a", ["n"], ["x"], True, 40), ("a", ["x"], ["x"], True, 50),
        ("b", None, None, False, None), ("c", ["q", "r", "s", "x"], ["x"], None, 1),
    ]
    df = spark.createDataFrame(rows, "g string, told array<string>, wanted array<string>, recovered boolean, latency int")
    found = {r["g"]: r for r in recognition(df, "g").collect()}
    a = found["a"]
    assert (a["cases"], a["tp"], a["fp"], a["fn"]) == (5, 3, 4, 3)
    assert (a["precision"], a["recall"], a["top1"], a["top3"], a["empty"], a["latency"]) == (3 / 7, 0.5, 0.4, 0.6, 0.2, 30.0)
    assert abs(a["false_recovery"] - 1 / 3) < 1e-12 and a["f1"] == 6 / 13
    assert (found["b"]["precision"], found["b"]["recall"], found["b"]["empty"], found["b"]["latency"]) == (0.0, 0.0, 1.0, None)
    assert (found["c"]["top1"], found["c"]["top3"]) == (0.0, 0.0)
