import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = "/root/testdata"

# Eight days of an invented pumping station, whole numbers; gate never moves.
GAUGE_HEADER = "day,level,inflow,outflow,pump,gate"
GAUGE_ROWS = [
    "1,410,35,30,0,7",
    "2,415,12,31,0,7",
    "3,396,0,29,1,7",
    "4,367,88,64,1,7",
    "5,391,54,61,1,7",
    "6,384,9,40,0,7",
    "7,353,17,22,0,7",
    "8,348,71,22,1,7",
]


@pytest.fixture(scope="session")
def spark():
    from shardwise.session import get_session

    ckpt = tempfile.mkdtemp(prefix="shardwise-test-ckpt-")
    spark = get_session("shardwise-tests", master="local[4]",
                        conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g"})
    from shardwise.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark, ckpt)
    yield spark
    spark.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="shardwise-test-")


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


@pytest.fixture()
def gauge_csv(tmpdir_path):
    """(path with header, path without header) of the 8-row gauge table."""
    d = os.path.join(tmpdir_path, "gauge")
    os.makedirs(os.path.join(d, "h"))
    os.makedirs(os.path.join(d, "n"))
    with_header = write(os.path.join(d, "h", "gauge.csv"), GAUGE_HEADER + "\n" + "\n".join(GAUGE_ROWS) + "\n")
    headerless = write(os.path.join(d, "n", "gauge.csv"), "\n".join(GAUGE_ROWS) + "\n")
    return with_header, headerless


@pytest.fixture()
def station_csv(tmpdir_path):
    """Headerless CSV: 800 rows, text id column, numeric columns with gaps."""
    d = os.path.join(tmpdir_path, "station")
    os.makedirs(d)
    lines = []
    for i in range(800):
        value = (i * 31 + 11) % 97 - 40
        extra = "" if i < 2 or i % 5 else str(i % 13)
        lines.append(f"PUMP-7,{5000 + i // 2},level,{value},{extra},,")
    return write(os.path.join(d, "pump7.csv"), "\n".join(lines) + "\n")


@pytest.fixture()
def parts_dir(tmpdir_path):
    """Four CSV parts with header: one zero-byte, one header-only, two with rows."""
    d = os.path.join(tmpdir_path, "parts")
    os.makedirs(d)
    write(os.path.join(d, "part-00000.csv"), "")
    write(os.path.join(d, "part-00001.csv"), "a,b\n1,10\n2,20\n")
    write(os.path.join(d, "part-00002.csv"), "a,b\n")
    write(os.path.join(d, "part-00003.csv"), "a,b\n3,30\n4,40\n5,50\n")
    return d
