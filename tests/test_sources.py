import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, samples
from trimline.operators import gitops
from trimline.params import Tiering
from trimline.sources import gitops as landed
from trimline.sources.bronze import read_samples, read_tail, write_samples
from trimline.sources.kubelet import pod_specs, read_documents, read_pod_documents, readable, rejected, usage_samples


def container(name, cpu=None, usage=None, ws=None):
    memory = None if usage is None and ws is None else {"usageBytes": usage, "workingSetBytes": ws}
    return {"name": name, "cpu": None if cpu is None else {"usageNanoCores": cpu}, "memory": memory}


def test_usage_documents(spark, tmp_path):
    document = {
        "node": {"nodeName": "n1"},
        "scraped_at": "2026-02-28T12:00:00Z",
        "pods": [
            {"podRef": {"name": "a", "namespace": "x"}, "containers": [container("m", 2**64 - 1, 5, 4), container("s", None, 7, None)]},
            {"podRef": {"name": "b", "namespace": "x"}, "containers": [container("m", 9)]},
            {"podRef": {"name": "idle", "namespace": "x"}, "containers": []},
            {"podRef": {"name": "gone", "namespace": "x"}},
        ],
    }
    (tmp_path / "d.json").write_text(json.dumps(document) + "\n{not json\n" + json.dumps({"node": {"nodeName": "n2"}, "pods": []}))
    documents = read_documents(spark, str(tmp_path))
    rows = {(r.pod_name, r.container_name): r for r in usage_samples(readable(documents)).collect()}
    assert set(rows) == {("a", "m"), ("a", "s"), ("b", "m")}
    assert int(rows[("a", "m")].cpu_nano) == 2**64 - 1
    assert [int(rows[("a", "s")][c]) for c in ("cpu_nano", "mem_usage", "mem_ws")] == [0, 7, 0]
    assert [int(rows[("b", "m")][c]) for c in ("cpu_nano", "mem_usage", "mem_ws")] == [9, 0, 0]
    assert rows[("a", "m")].ts == T0
    assert [r._corrupt_record for r in rejected(documents).collect()] == ["{not json"]


def test_pod_documents(spark, tmp_path):
    def pod(name, refs, statuses, resources):
        return {
            "metadata": {"name": name, "namespace": "x", "ownerReferences": refs},
            "spec": {"containers": [{"name": "m", "resources": resources}], "initContainers": [{"name": "init"}]},
            "status": {"qosClass": "Burstable", "containerStatuses": statuses},
        }

    items = [
        pod("a", [{"kind": "ReplicaSet", "name": "web-1", "controller": True}],
            [{"name": "m", "restartCount": 1}, {"name": "m", "restartCount": 5}, {"name": "z", "restartCount": 9}],
            {"requests": {"cpu": "250m", "memory": "1Gi"}, "limits": {"cpu": "1", "memory": "bad"}}),
        pod("b", None, None, {}),
    ]
    (tmp_path / "p.json").write_text(json.dumps({"items": items}))
    rows = {r.pod_name: r for r in pod_specs(readable(read_pod_documents(spark, str(tmp_path)))).collect()}
    assert len(rows) == 2
    a, b = rows["a"], rows["b"]
    assert (a.cpu_request_millis, a.cpu_limit_millis, a.mem_request_bytes, a.mem_limit_bytes, a.restart_count) == (250, 1000, 1 << 30, 0, 5)
    assert (a.owner_kind, a.owner_name, a.qos_class) == ("Deployment", "web", "Burstable")
    assert (b.cpu_request_millis, b.restart_count, b.owner_kind) == (0, 0, "")


def test_bronze_reads_only_the_days_it_needs(spark, tmp_path):
    from datetime import timedelta

    path = str(tmp_path / "bronze")
    rows = [(T0 - timedelta(days=d), d + 1) for d in range(20)]
    write_samples(samples(spark, rows), path)
    t = Tiering(as_of=T0)
    assert read_samples(spark, path, Tiering()).count() == 20
    kept = read_samples(spark, path, t)
    assert kept.count() == 8
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert read_tail(spark, path, t).count() == 1
    with pytest.raises(ValueError):
        read_tail(spark, path, Tiering())


def test_mapping_documents(spark, tmp_path):
    def write(name, document):
        (tmp_path / name).write_text(json.dumps(document, indent=1))
        return str(tmp_path / name)

    argo = write("argo.json", {"items": [{
        "metadata": {"name": "app", "namespace": "argocd"},
        "spec": {"source": {"repoURL": "https://git.example/a", "path": "apps/a"}},
        "status": {"resources": [{"kind": "Deployment", "name": "web", "namespace": "prod"}, {"kind": "Service", "name": "web", "namespace": "prod"}]},
    }]})
    flux = write("flux.json", {"items": [
        {"metadata": {"name": "k", "namespace": "flux-system"}, "spec": {"path": "./k", "sourceRef": {"kind": "GitRepository", "name": "main"}},
         "status": {"inventory": {"entries": [{"id": "ns_api_v2_apps_Deployment"}, {"id": "ns_api__Service"}, {"id": "bad"}]}}},
        {"metadata": {"name": "k2", "namespace": "other"}, "spec": {"path": "./z", "sourceRef": {"name": "main"}},
         "status": {"inventory": {"entries": [{"id": "ns_db_apps_StatefulSet"}]}}},
        {"metadata": {"name": "k3", "namespace": "other"}, "spec": {"path": "./y", "sourceRef": {"name": "main", "namespace": "flux-system"}},
         "status": {"inventory": {"entries": [{"id": "ns_log_apps_DaemonSet"}]}}},
    ]})
    repos = write("repos.json", {"items": [{"metadata": {"name": "main", "namespace": "flux-system"}, "spec": {"url": "https://git.example/f"}}]})
    mappings = gitops.all_mappings(
        gitops.argo_mappings(landed.argo_resources(spark, argo)),
        gitops.flux_mappings(landed.flux_inventory(spark, flux), landed.flux_repositories(spark, repos)),
    )
    got = {tuple(r) for r in mappings.collect()}
    assert got == {
        ("prod", "Deployment", "web", "https://git.example/a", "apps/a", "argocd"),
        ("ns", "Deployment", "api_v2", "https://git.example/f", "./k", "flux"),
        ("ns", "StatefulSet", "db", "", "./z", "flux"),
        ("ns", "DaemonSet", "log", "https://git.example/f", "./y", "flux"),
    }
    assert gitops.all_mappings(None, gitops.argo_mappings(landed.argo_resources(spark, argo))).count() == 1
    assert gitops.all_mappings(gitops.empty_mappings(spark)).count() == 0
    command = gitops.annotate_commands(mappings, "tool").filter("name = 'web'").first()
    assert command.args == ["annotate", "deployment/web", "-n", "prod", "--repo", "https://git.example/a", "--path", "apps/a"]
    assert command.display == "tool " + " ".join(command.args)


def test_annotation_requests(spark):
    rows = [
        ("deployment/api", "", "git.example/r", "a.yaml", None), ("statefulset/redis", "cache", "git.example/r", "b.yaml", "resources"),
        ("payment-service", "", "r", "p", ""), ("/payment", "", "r", "p", ""), ("deployment/", "", "r", "p", ""),
        ("deployment/api", "", "", "p", ""), ("deployment/api", "", "r", "", ""), ("deployment/api", "", "-r", "p", ""), ("deployment/api", "", "r", "p", "-f"),
        ("deployment/a/b", "", "r", "p", ""),
    ]
    checked = gitops.annotation_arguments(
        spark.createDataFrame(rows, "target string, namespace string, repo string, path string, field string").coalesce(1), "sizing.example"
    ).collect()
    assert checked[0].args == ["annotate", "deployment/api", "sizing.example/repo=git.example/r", "sizing.example/path=a.yaml", "--overwrite"]
    assert checked[1].args == ["annotate", "statefulset/redis", "-n", "cache", "sizing.example/repo=git.example/r", "sizing.example/path=b.yaml",
                               "sizing.example/field=resources", "--overwrite"]
    assert ["kind/name" in (r.error or "") for r in checked[2:5]] == [True] * 3
    assert [r.error for r in checked[5:9]] == ["repo is required", "path is required", "values must not start with '-'", "values must not start with '-'"]
    assert checked[9].error is None and all(r.args is None for r in checked[2:9])


def test_source_annotations(spark):
    rows = [('{"d/repo": "r", "d/path": "p", "d/field": "f", "x": "y"}',), ('{"d/repo": "r"}',), ("{}",), (None,), ("nonsense",)]
    got = gitops.read_annotations(spark.createDataFrame(rows, "annotations string").coalesce(1), "d").collect()
    assert (got[0].repo, got[0].path, got[0].field, got[0].annotation_error) == ("r", "p", "f", None)
    assert all("missing required annotations" in r.annotation_error for r in got[1:])
