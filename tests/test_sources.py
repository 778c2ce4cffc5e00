"""Readers / writers: response layouts, short values, drift, report formats."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from capstan.session import scratch_path
from capstan.sources import readers as rd
from capstan.sources import writers as wr


def _write(d, name, obj):
    with open(os.path.join(d, name), "w") as f:
        json.dump(obj, f, indent=2)


def test_range_results_three_layouts_and_nan(spark):
    d = tempfile.mkdtemp(prefix="capstan-range-")
    item = {"metric": {"__name__": "cpu", "pod": "a"}, "values": [[1700000000, "0.5"], [1700000015.5, "NaN"]]}
    _write(d, "a.json", {"data": {"result": [item]}})
    _write(d, "b.json", {"result": [item]})
    _write(d, "c.json", [item])
    r = rd.read_range_results(spark, d)
    assert r.count() == 6
    assert r.where(F.col("value").isNull()).count() == 3          # NaN -> NULL
    assert {x["metric"] for x in r.collect()} == {"cpu"}


def test_instant_vector_short_value_defaults_to_zero(spark):
    d = tempfile.mkdtemp(prefix="capstan-vec-")
    _write(d, "v.json", {"status": "success", "data": {"resultType": "vector", "result": [
        {"metric": {"pod": "p", "container": "c", "resource": "cpu"}, "value": [1234567890, "0.2"]},
        {"metric": {"pod": "q", "container": "c", "resource": "memory"}, "value": [1234567890]}]}})
    v = {x["pod"]: x["value"] for x in rd.resource_requests(rd.read_instant_vector(spark, d)).collect()}
    assert v == {"p": 0.2, "q": 0.0}


def test_inventory_without_status_match(spark):
    from capstan.schemas import PODS
    d = tempfile.mkdtemp(prefix="capstan-pods-")
    _write(d, "p.json", {"name": "web-1", "namespace": "default", "status": "Running", "labels": {"app": "web"},
                         "containers": [{"name": "app", "image": "i", "requests": {"cpu": "100m"}, "limits": {}},
                                        {"name": "side", "image": "j", "requests": {}, "limits": {}}],
                         "statuses": [{"name": "app", "ready": True, "restart_count": 2}]})
    f = {x["container"]: x for x in rd.flatten_inventory(spark.read.schema(PODS).option("multiLine", True)
                                                         .json(d)).collect()}
    assert f["app"]["cpu_request"] == "100m" and f["app"]["restart_count"] == 2
    assert f["side"]["ready"] is None and f["side"]["cpu_request"] is None


def test_report_formats(spark):
    rep = spark.createDataFrame([("statistical", 1.0, 2.0, 0.1, 0.01, 3)],
                                "strategy string, mean_cpu_hours double, mean_memory_hours double, "
                                "mean_p95_latency double, mean_error_rate double, total_scaling_events long")
    md = [r["line"] for r in wr.strategy_report_lines(rep, None, "svc").orderBy("_o").collect()]
    assert md[0].startswith("# Comparative report") and any("statistical" in x for x in md)
    js = wr.strategy_report_lines(rep, None, "svc", fmt="json").collect()
    assert json.loads(js[0]["line"])["cost_efficiency"][0]["strategy"] == "statistical" and len(js) == 1
    for fmt in ("markdown", "json", "csv"):
        path = wr.write_report(wr.strategy_report_lines(rep, None, "svc", fmt=fmt), scratch_path(spark, "report"))
        assert spark.read.text(path).count() >= 1
    assert wr.strategy_report_lines(rep, None, "svc", fmt="csv").first()["line"] == "Unsupported output format"


def test_value_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, cpu_value double, s string")
    assert rd.value_columns(df) == ["cpu_value"]
    assert rd.value_columns(df.drop("cpu_value")) == ["a"]
