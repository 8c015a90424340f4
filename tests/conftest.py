from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from kerbline.session import build_session

    scratch = tempfile.mkdtemp(prefix="kerbline-")
    session = build_session(
        "kerbline-tests", "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__sql__warehouse__dir=f"{scratch}/warehouse",
        spark__python__sql__dataFrameDebugging__enabled="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_sf():
    path = TESTDATA / "sf0.001"
    if not path.exists():
        pytest.skip("test tables are not present")
    return str(path)


def records(df, *columns):
    """Rows as a sorted list of tuples (NULLs last)."""
    picked = df.select(*columns) if columns else df
    rows = [tuple(r) for r in picked.collect()]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
