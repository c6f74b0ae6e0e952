"""The command line on text files: whole lines against plain code."""

import datetime
import json
import random

import pytest

from tideline import __main__ as cli

HOURS = {f"{h:02d}": h % 5 + 1 for h in range(24)}
CODES = {"timezone_codes": {str(i): i * 2 for i in range(1, 8)}, "day_codes": {str(i): i for i in range(1, 8)}, "month_codes": {f"{i:02d}": i % 4 for i in range(1, 13)}, "season_codes": {str(i): i * 3 for i in range(1, 5)}, "day_of_month_codes": {str(i): i % 6 for i in range(1, 32)}, "hour_codes": HOURS}
HOUSEHOLDS = ["h_1", "h2", "h3"]


@pytest.fixture()
def folder(tmp_path):
    rng = random.Random(7)
    start = datetime.datetime(2016, 2, 1)
    line = lambda i, h, *rest: ";".join([h, (start + datetime.timedelta(hours=i)).strftime("%d/%m/%Y %H:00"), *rest])
    amount = lambda: rng.choice(["0", "0", f"{rng.random() * 9 + 0.5:.2f}"])
    (tmp_path / "S").write_text("\n".join(line(i, h, a, a) for i in range(60) for h in [*HOUSEHOLDS, "gone"] for a in [amount()]))
    (tmp_path / "R").write_text("\n".join(line(i, h) for i in range(60, 72) for h in HOUSEHOLDS))
    (tmp_path / "codes").mkdir()
    files = CODES | {"outliers": {"0": ["gone"]}, "customer_category_codes": {"0": ["h_1", "h2"], "1": ["h3", "gone"]}, "customer_codes": {h: {x: i for i, x in enumerate([*HOUSEHOLDS, "gone"])} for h in HOURS}, "customer_category_monthly_codes": {"h_1": 1, "h2": 2, "h3": 3, "gone": 4}}
    for name, held in files.items():
        (tmp_path / "codes" / f"{name}.txt").write_text(json.dumps(held) + "\n")
    return tmp_path


def lines(folder, name):
    return sorted(x for f in (folder / name).glob("part-*") for x in f.read_text().splitlines())


def plain_run(r, s, k, classify):
    """Result lines of feature lines by the definition, with the default scale."""
    scale, out = (10, 9, 5, 5, 8, 3, 17, 8, 29, 5), []
    point = lambda x: [int(float(f) * w * 10) for f, w in zip(x.split(",")[1:11], scale, strict=True)]
    target = lambda x: float(x.split(",")[12 if classify else 11])
    training = [(point(x), target(x)) for x in s]
    for x in r:
        q, head = point(x), f"{x.split(',')[0]}:{target(x)}"
        near = sorted((sum((a - b) ** 2 for a, b in zip(q, p, strict=True)), t) for p, t in training)
        out.append((head, near[:k], near[k:]))
    return out


def test_forecast_from_raw_readings(spark, folder):
    base = ["--base-path", str(folder), "--k", "5", "--exact"]
    cli.main(["features", *base])
    r, s = lines(folder, "RClassification"), lines(folder, "SClassification")
    assert len(r) == 36 and len(s) == 180 and all(x.endswith(",-1.0,-1.0") for x in r)
    # h_1 on Wednesday 3 February 2016 at 13 h: working time, winter
    assert [x for x in r if x.startswith("h_1_03/02/2016-13,")] == ["h_1_03/02/2016-13,4.0,14.0,3.0,2.0,3.0,1.0,1.0,0.0,1.0,3.0,-1.0,-1.0"]
    cli.main(["forecast", *base])
    results = lines(folder, "ClassificationResults")
    assert len(results) == 36
    got = dict(x.split(" | Result ") for x in results)
    for head, near, rest in plain_run(r, s, 5, True):
        low, high = near[0][0] ** 0.5, near[-1][0] ** 0.5
        votes = {1.0: 0.0, 2.0: 0.0}
        for d2, t in near:
            votes[t] += 1.0 if low == high else (high - d2**0.5) / (high - low)
        if rest and rest[0][0] == near[-1][0]:
            continue  # a tie of distances goes by ids, which files do not show
        result, one, two, end = got[head].split(" | ")
        assert end == "" and head.endswith(":-1.0") and one.startswith("Class 1 probability ")
        assert float(one.split()[-1]) == pytest.approx(votes[1.0] / sum(votes.values())) and float(two.split()[-1]) == pytest.approx(votes[2.0] / sum(votes.values()))
        assert votes[1.0] == pytest.approx(votes[2.0]) or float(result) == max(votes, key=votes.get)
    positive = {x.split(":-1.0")[0] for x in results if " | Result 2.0 | " in x}
    assert {x.split(",")[0] for x in lines(folder, "RRegression")} == positive and all(x.endswith(",2.0") for x in lines(folder, "SRegression"))
    assert lines(folder, "UnifiedNonZeroDataset") == sorted(lines(folder, "RRegression") + lines(folder, "SRegression"))
    values = dict(x.split(":-1.0 | Result: ") for x in lines(folder, "RegressionResults"))
    assert set(values) == positive
    want = []
    for x in r:
        key = x.split(",")[0]
        household, at = key.rsplit("_", 1)
        want.append(f"{household};{at[:10]} {at[11:]}:00:00;{values.get(key, '0.0')}")
    assert lines(folder, "FinalResults") == sorted(want)


def test_unknown_targets_and_too_few_neighbours(spark, folder):
    (folder / "RClassification").write_text("a,1,2,3,-1,-1\nb,1,2,4,-1,2\nb,1,2,4,-1,2\n")
    (folder / "SClassification").write_text("x,1,2,3,0,1\ny,1,2,5,7,2\nz,9,9,9,1,1\n")
    small = ["--base-path", str(folder), "--dimension", "3", "--mode", "classify", "--exact"]
    cli.main([*small, "--k", "2"])
    assert lines(folder, "ClassificationResults") == ["a:-1.0 | Result 1.0 | Class 1 probability 1.0 | Class 2 probability 0.0 | ", *["b:2.0 | Result 1.0 | Class 1 probability 0.5 | Class 2 probability 0.5 | "] * 2]
    cli.main([*small, "--k", "4"])
    assert lines(folder, "ClassificationResults") == ["a:-1.0 ERROR!", "b:2.0 ERROR!", "b:2.0 ERROR!"]


def test_validate_and_search(spark, folder, capsys, monkeypatch):
    rng = random.Random(3)
    text = "".join(f"i{i},{i % 2 * 5 + rng.random():.3f},{rng.random():.3f},{rng.random():.3f},{i % 2 * 10 + 1},{i % 2 + 1}\n" for i in range(60))
    for kind in ("Classification", "Regression"):
        (folder / f"S{kind}").write_text(text)
    base = ["--base-path", str(folder), "--dimension", "3", "--k", "3", "--exact", "--folds", "4"]
    cli.main(["validate", *base, "--mode", "classify"])
    cli.main(["validate", *base, "--mode", "regress"])
    printed = capsys.readouterr().out.split()
    assert printed[:4] == ["accuracy", "100.0", "f_measure", "1.0"] and printed[4] == "r2_explained" and float(printed[7]) < 1.0
    from dataclasses import replace

    from tideline.plans.search import SearchConfig, search

    monkeypatch.setattr(cli, "search", lambda score, domain, config: search(score, domain, replace(config, population=3, generations=2)))
    (folder / "RClassification").write_text(text)
    cli.main(["run", *base, "--mode", "classify", "--search"])
    assert "best scale [" in capsys.readouterr().out and len(lines(folder, "ClassificationResults")) == 60
