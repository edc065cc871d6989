import json

from ridgeline.__main__ import main


def test_all_commands(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    auth, flows = [], []
    for k in range(240):
        source, target = ("C5", f"C{300 + k % 20}") if 100 <= k < 120 else (f"C{k % 16 + 10}", f"C{k * 7 % 20 + 100}")
        auth.append(f"{k},U{k % 9}@DOM1,x,{source},{target},{('NTLM', 'Kerberos')[k % 2]},Network,LogOn,Success")
        flows.append(f"{k},0,{source},445,{target},N1,6")
    (raw / "auth.txt").write_text("\n".join(auth))
    (raw / "flows.txt").write_text("\n".join(flows))
    (raw / "redteam.txt").write_text("110,U1@DOM1,C5,C310\n")
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"data_root": str(tmp_path / "data"), "output_root": str(tmp_path / "out"), "thresholds": {"M_min": 70, "E_min": 30, "V_min_src": 10, "V_min_dst": 10}, "training": {"epochs": 100, "fusion_alpha": 0.6}, "seeds": [42], "pivots": ["C5"]}))
    run = lambda command, *more: main([command, "--config", str(config), *more], spark)
    run("preprocess", "--raw-dir", str(raw))
    assert json.loads(capsys.readouterr().out)["prepared"]["auth"] == {"rows": 240}
    run("windows")
    document = json.loads((tmp_path / "out/windows.json").read_text())
    assert document["n_windows"] >= 3 and document["scanned_events"] == 240 and any(w["attack_pivots"] == ["C5"] for w in document["windows"])
    run("stats")
    assert "| Events |" in (tmp_path / "out/window_stats.md").read_text()
    run("benchmark", "--epochs", "3")
    result = json.loads((tmp_path / "out/benchmark.json").read_text())
    assert result["summary"]["n"] == 1 and result["failed"] == [] and result["windows"][0]["n_seeds"] == 1
    run("stability", "--epochs", "2", "--limit", "2")
    run("ablation", "--epochs", "2")
    assert spark.read.parquet(str(tmp_path / "out/ablation.parquet")).count() == 14
    summary = spark.read.parquet(str(tmp_path / "out/stability_summary.parquet")).first()
    assert summary.windows == 2 and summary.top50_jaccard_pairs == 1 and summary.failed == 0 and summary.leaders >= 1
    assert spark.read.parquet(str(tmp_path / "out/stability_top.parquet")).count() > 0
    run("windows", "--kind", "fixed", "--events-per-window", "100", "--out", str(tmp_path / "fixed"))
    assert json.loads((tmp_path / "fixed/windows.json").read_text())["n_windows"] == 2
    run("ablation", "--epochs", "2", "--fixed-windows", str(tmp_path / "fixed"))
    studies = {(r.study, r.config): r for r in spark.read.parquet(str(tmp_path / "out/ablation.parquet")).collect()}
    assert len(studies) == 15 and studies["windowing", "fixed-event"].windows >= 1 and studies["windowing", "fixed-event"].failed == 0
    main(["toy", "--epochs", "2"], spark)
    assert "C5" in capsys.readouterr().out
