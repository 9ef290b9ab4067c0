"""Each registered query of the library against its DuckDB SQL, and those without SQL for a stable, non-empty result."""

import pytest

from scanweave.plans import registry

from .conftest import canonical

Q, S = registry.queries(), registry.oracle_sql()
#: Clouds of a hundred points have no ground plane and are too thin to enclose anything.
MAY_BE_EMPTY = {"m1_ground_planes", "p9_height", "m6b_enclosed_voxels", "m6b_j8_void_interior"}


@pytest.mark.parametrize("name", sorted(S))
def test_matches_sql(name, spark, duck, sf):
    got = Q[name](spark, sf).toPandas()
    want = duck.sql(S[name]).df()
    assert len(want) or name in MAY_BE_EMPTY
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.where(got.notna(), None)) == canonical(want.where(want.notna(), None))


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_runs(name, spark, sf):
    rows = Q[name](spark, sf).toPandas()
    again = Q[name](spark, sf).toPandas()
    assert len(rows) and canonical(rows.where(rows.notna(), None)) == canonical(again.where(again.notna(), None))


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) >= len(Q)
