"""The jobs over copies that grow, against SQL over what has come so far."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from gridstat.plans import registry
from jobs import assignment, profiles
from jobs.command import config_of

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def shown(v):
    return None if v is None else round(v, 6) + 0.0 if isinstance(v, float) else v


def of_sql(name, **views):
    con = duckdb.connect()
    for view, path in views.items():
        con.sql(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{path}')")
    rel = con.sql(registry.ORACLES[name])
    return rel.columns, sorted((tuple(shown(v) for v in r) for r in rel.fetchall()), key=str)


def of_spark(df, columns):
    return sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=str)


def test_profiles_take_only_what_is_new(spark, tmp_path, caplog):
    """Files that come between runs are added; a run without new ones, and one that repeats a batch, change nothing."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumnRenamed("lang", "l").selectExpr("doc_id", "text", "nullif(l, 'fr') lang", "source", "n_chars")
    into, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    config = config_of("profiles") | {"files_per_batch": 1}
    read = lambda: [r.getMessage() for r in caplog.records if "rows in batch" in r.getMessage()]
    with caplog.at_level("INFO", "jobs.profiles"):
        for part, files in ((0, 2), (1, 1)):
            docs.filter(f"doc_id % 2 = {part}").coalesce(1).repartition(files).write.mode("append").parquet(into)
            before = len(read())
            got = profiles.run(spark, into, out, check, config)
            columns, want = of_sql("job1_profiles", documents=f"{into}/*.parquet")
            assert of_spark(got, columns) == want
            assert len(read()) - before == files
        seen = len(read())
        assert of_spark(profiles.run(spark, into, out, check, config), columns) == want
        assert len(read()) == seen
        # as if the run had been lost after its last batch was written and before it was noted
        last = max((p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        assert of_spark(profiles.run(spark, into, out, check, config), columns) == want
        assert len(read()) == seen + 1
    # a new checkpoint counts everything anew, beside the old stream's counts
    assert of_spark(profiles.run(spark, into, out, str(tmp_path / "other"), config), columns) == want


def test_profiles_of_odd_rows(spark, tmp_path):
    """Null and empty sequences, a null group, repeated rows and other columns of clashing names."""
    rows = [(1, None, "a", 1), (1, None, "a", 1), (2, "", "a", 1), (3, "Az-9\n\U0001F4A9é", None, 1), (4, "b", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, col_ix int").write.parquet(str(tmp_path / "in"))
    got = profiles.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {(r["grp"], r["col_ix"], r["n_rows"], r["gap_fraction"]) for r in got.collect()} == {(None, 0, 2, 0.0), (None, 1, 2, 0.0), *((None, i, 2, 1.0) for i in range(2, 7))}


def test_assignment(spark, tmp_path):
    """A second run with fewer hits leaves nothing of the first one."""
    hits = spark.read.parquet(f"{DATA}/orders.parquet")
    records = spark.read.parquet(f"{DATA}/customer.parquet")
    paths = [str(tmp_path / n) for n in ("hits", "records", "out")]
    records.filter("c_custkey % 7 != 1").write.parquet(paths[1])
    for keep in ("true", "o_orderpriority != '2-HIGH' and o_custkey % 3 = 1"):
        hits.filter(keep).write.mode("overwrite").parquet(paths[0])
        got = assignment.run(spark, *paths)
        columns, want = of_sql("job2_assignment", orders=f"{paths[0]}/*.parquet", customer=f"{paths[1]}/*.parquet")
        assert of_spark(got, columns) == want
        summary = spark.read.json(f"{paths[2]}/summary").agg({"calls": "sum", "representatives": "sum"}).first()
        assert sorted(summary) == sorted([len(want), sum(r[columns.index("representative")] for r in want)])
    assert any(r[columns.index("verdict")] == "no_record" for r in want)


def test_command_line(tmp_path):
    """From a shell, with a config of its own; an unknown setting is an error."""
    (tmp_path / "c.json").write_text(json.dumps({"min_margin": 1.5}))
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    command = [sys.executable, "-m", "jobs.assignment", "--hits", f"{DATA}/orders.parquet", "--records", f"{DATA}/customer.parquet", "--output", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")]
    done = subprocess.run(command, cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 1500 hits" in done.stderr and "with verdict ambiguous" in done.stderr
    (tmp_path / "c.json").write_text(json.dumps({"margin": 2}))
    with pytest.raises(ValueError, match="margin"):
        config_of("assignment", str(tmp_path / "c.json"))
