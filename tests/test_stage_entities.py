import json

from leafmill.plans import records as R

BODY = "struct<evidence string, artifacts array<string>, mutations array<struct<kind string, target string, before string, after string>>, warnings array<string>, errors array<string>>"
SCHEMA = f"run_id string, stages map<string,{BODY.replace(' string', ':string').replace(' array', ':array')}>, cleanup_obligations array<struct<kind:string,resource_id:string,status:string,message:string>>"


def test_lists_of_stages_are_rows(spark, tmp_path):
    load = ('{"mutations": [{"kind": "evidence"}]}', ["a.txt", None], [("write", "t", None, "new"), None, ("drop", "u", "old", None)], ["late"], None)
    run = ("r1", {"load": load, "gone": None, "bare": ("", None, None, [], ["bad"])}, [("lock", "7", "open", "m"), None])
    spark.createDataFrame([run, run, ("r2", None, None)], SCHEMA).write.parquet(str(tmp_path / "run_results.parquet"))
    d = str(tmp_path)
    got = {(r["stage"], r["path"]): json.loads(r["fields"]) for r in R.p3_entities(spark, d).collect()}
    assert {k[0] for k in got if k[1] in ("", R.STAGE)} == {"load", "bare"} and got["bare", R.STAGE] == {"artifacts": None, "mutations": None, "warnings": []}
    assert got["load", "(stage).artifacts[1]"] == {"value": None} == got["load", "(stage).mutations[1]"]
    got = {k: {x: y for x, y in v.items() if y is not None} for k, v in got.items() if k[1] not in ("", R.STAGE) and v != {"value": None}}
    assert got == {
        ("load", "mutations[0]"): {"kind": "evidence"}, ("load", "(stage).mutations[0]"): {"kind": "write", "target": "t", "after": "new"}, ("load", "(stage).mutations[2]"): {"kind": "drop", "target": "u", "before": "old"},
        ("load", "(stage).artifacts[0]"): {"value": "a.txt"}, ("load", "(stage).warnings[0]"): {"value": "late"}, ("bare", "(stage).errors[0]"): {"value": "bad"},
        ("", "cleanup_obligations[0]"): {"kind": "lock", "resource_id": "7", "status": "open", "message": "m"},
    }
    rows = sorted((r["stage"], r["ordinal"], r["kind"], r["target"], r["before"], r["after"]) for r in R.p3_mutations(spark, d).collect())
    assert rows == [("load", 0, "write", "t", None, "new"), ("load", 2, "drop", "u", "old", None)]
    assert sorted((r["entity"], r["stage"], r["value"]) for r in R.p3_messages(spark, d).collect()) == [("artifacts", "load", "a.txt"), ("errors", "bare", "bad"), ("warnings", "load", "late")]
    assert [(r["run_id"], r["resource_id"]) for r in R.p3_obligations(spark, d).collect()] == [("r1", "7")]
