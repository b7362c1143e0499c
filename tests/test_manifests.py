import pytest

from trimline.operators.manifests import (
    NOTHING_CHANGED,
    NOTHING_CHANGED_IN_VALUES,
    OUTSIDE,
    UNREADABLE,
    UNSUPPORTED,
    edit_manifests,
)

BLOCK = """spec:
  containers:
  - name: api
    resources:
      requests:
        cpu: {0}
        memory: {1}
      limits:
        cpu: {2}
        memory: {3}
"""
MI = 1 << 20


def edit(spark, content, resource="cpu", request=250, limit=500, path="deploy.yaml", field=""):
    ddl = "path string, content string, field string, resource string, recommended_request bigint, recommended_limit bigint"
    return edit_manifests(spark.createDataFrame([(path, content, field, resource, request, limit)], ddl)).first()


def test_cpu_and_memory(spark):
    content = BLOCK.format("1000m", "512Mi", "2000m", "1Gi")
    assert edit(spark, content).new_content == BLOCK.format("250m", "512Mi", "500m", "1Gi")
    assert edit(spark, content, limit=0).new_content == BLOCK.format("250m", "512Mi", "2000m", "1Gi")
    assert edit(spark, content, "memory", 256 * MI, 768 * MI).new_content == BLOCK.format("1000m", "256Mi", "2000m", "768Mi")


def test_quotes_are_dropped_and_comments_kept(spark):
    content = BLOCK.format('"500m" # now', "'512Mi'", '"1"', '"1Gi"')
    assert edit(spark, content).new_content == BLOCK.format("250m # now", "'512Mi'", "500m", '"1Gi"')


def test_every_block_of_the_file_is_edited(spark):
    content = BLOCK.format("1", "1Gi", "2", "2Gi") * 2
    assert edit(spark, content).new_content == BLOCK.format("250m", "1Gi", "500m", "2Gi") * 2


def test_a_block_ends_at_an_unindented_line(spark):
    content = "requests:\nother: 1\n  cpu: 1\n"
    assert edit(spark, content).error == NOTHING_CHANGED
    assert edit(spark, "requests:\ncpu: 1\nmemory: 1Gi\n").new_content == "requests:\ncpu: 250m\nmemory: 1Gi\n"


@pytest.mark.parametrize("memory", ["134217728", "1.5Gi"])
def test_memory_without_a_whole_suffixed_number_is_left(spark, memory):
    row = edit(spark, BLOCK.format("1", memory, "1", memory), "memory", 256 * MI, 512 * MI)
    assert row.error == NOTHING_CHANGED and not row.changed


def test_errors(spark):
    fraction = BLOCK.format("0.5", "1Gi", "1", "1Gi")
    row = edit(spark, fraction)
    assert (row.error, row.new_content) == (UNSUPPORTED, fraction)
    assert edit(spark, BLOCK.format("250m", "1Gi", "500m", "1Gi")).error == NOTHING_CHANGED
    assert edit(spark, "image: nginx\n").error == NOTHING_CHANGED
    assert edit(spark, "image: nginx\n", path="chart/values.yaml", field="resources").error == NOTHING_CHANGED_IN_VALUES
    assert edit(spark, "image: nginx\n", path="chart/values.yml").error == NOTHING_CHANGED
    assert edit(spark, BLOCK.format("1", "1Gi", "1", "1Gi"), path="../x.yaml").error == OUTSIDE
    assert edit(spark, BLOCK.format("1", "1Gi", "1", "1Gi"), resource="disk").error == NOTHING_CHANGED


def test_values_file(spark):
    content = "replicaCount: 3\nresources:\n  requests:\n    cpu: 1000m\n    memory: 512Mi\n  limits:\n    cpu: 2000m\n"
    row = edit(spark, content, path="chart/values.yaml", field="resources.requests.cpu")
    assert row.new_content == content.replace("1000m", "250m").replace("2000m", "500m") and row.changed


def test_a_file_without_content_is_an_error_row(spark):
    row = edit(spark, None)
    assert (row.error, row.new_content, row.changed) == (UNREADABLE, None, False)
    assert edit(spark, "").error == NOTHING_CHANGED


def test_an_odd_value_of_a_later_block_stops_the_edit(spark):
    content = BLOCK.format("1", "1Gi", "2", "2Gi") + BLOCK.format("0.25", "1Gi", "2", "2Gi")
    row = edit(spark, content)
    assert (row.error, row.new_content) == (UNSUPPORTED, content)
