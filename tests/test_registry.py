"""Schema versions handed out to several drivers at once."""
from concurrent.futures import ThreadPoolExecutor

from sluice.plans.ingest import Lake, register_schema
from sluice.sources import files


def test_versions_are_never_handed_out_twice(spark, tmp_path):
    """Runs that know nothing of each other register schemas of one source: equal ones share a version."""
    lake = Lake(str(tmp_path / "lake"))
    kinds = [[("a", "string")], [("a", "string"), ("b", "string")], [("b", "string"), ("a", "string")], [("c", "int")]]

    def run(k):
        return k % 4, register_schema(spark, lake, "s", "structured", kinds[k % 4], f"r{k}")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(run, range(4)))
    rows = lake.read_section(spark, "schema_registry").collect()
    assert sorted(r["version"] for r in rows) == list(range(1, len(rows) + 1))
    fields = {r["version"]: {f["name"] for f in r["fields"]} for r in rows}
    assert all(fields[v] == {n for n, _ in kinds[k]} for k, v in got)


def test_a_claim_without_a_row_is_passed_over(spark, tmp_path):
    lake = Lake(str(tmp_path / "lake"))
    assert register_schema(spark, lake, "s", "structured", [("a", "string")], "r1") == 1
    claim = next(p for p in (tmp_path / "lake" / "catalog" / "_claims").iterdir())
    assert files.create_exclusive(spark, f"{claim}/2") and not files.create_exclusive(spark, f"{claim}/2")
    assert register_schema(spark, lake, "s", "structured", [("b", "string")], "r2", claim_seconds=0.5) == 3
    assert register_schema(spark, lake, "s", "structured", [("b", "string")], "r3") == 3
    assert register_schema(spark, lake, "other/name", "structured", [("b", "string")], "r3") == 1
