"""Files listed and read by tasks."""

import pytest
from pyspark.sql import functions as F

from herdsignal.sources import files, readings as SR


ODD_FILES = {
    "a=1|0.csv": b"ts,act,temp\n946684801,1.5,38\n\n  \n946684802,NaN,\n946684803\nx,1,2\n",
    "b+%7C c|1.csv": b"\xef\xbb\xbfts,act,temp\r\n946684801,2,38\r\n946684802,,\"39\"\r\n946684803,1,2,3",
    "\u00e4\u65e5|2.csv": b"\n\nts,act,temp\n946684801,4,\xff\n1,2\x0b,\xe2\x80\xa8\n946684804,+5,1e3\n",
    "c|x.csv": b"",
    "d|3.csv": b"ts,act,temp",
    "below/deeper/e|0.csv": b"ts,act,temp\n" + b"".join(b"%d,%d,1\n" % (946684801 + i, i) for i in range(200)),
    "below/_no/f|0.csv": b"ts,act,temp\n946684801,9,9\n",
    ".g|0.csv": b"ts,act,temp\n946684801,9,9\n",
    "_h|0.csv": b"ts,act,temp\n946684801,9,9\n",
    "i|0.csv.bak": b"ts,act,temp\n946684801,9,9\n",
    "j|0.csv": b"ts,act,temp\n\"946684801\",\"1\",\"a,b\"\n946684801,\"1,2\n946684802,1,2\n",
}


@pytest.mark.parametrize("layouts", [1, 3])
def test_tasks_read_like_readers(spark, tmp_path, monkeypatch, layouts):
    for name, data in ODD_FILES.items():
        path = tmp_path / "drop one" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    if layouts > 1:
        (tmp_path / "drop one" / "k|0.csv").write_text("ts,temp,more\n946684801,7,x\n")
        (tmp_path / "drop one" / "l|0.csv").write_text('"ts",ts,act\n946684801,7,8\n')
    monkeypatch.setattr(files, "PIECE", 700)
    drop = str(tmp_path / "drop one")
    without = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(drop)
    without = without.select(F.col("_metadata.file_path").alias("file")).where("file LIKE '%/e%7C0.csv' OR file LIKE '%b+%'")
    without = spark.createDataFrame(without.collect(), "file string")
    for left_out in (None, without):
        mine = SR.read_sensor_csv(spark, drop, left_out)
        assert not any(name.endswith(".csv") for name in mine.inputFiles())  # the driver lists none of them
        with monkeypatch.context() as m:
            m.setattr(files, "listed", lambda *_: None)
            readers = SR.read_sensor_csv(spark, drop, left_out)
        got, want = (sorted(map(repr, df.collect())) for df in (mine, readers))
        assert got == want and len(want) > (200 if left_out is None else 5)


def test_pieces_of_a_file(tmp_path, monkeypatch):
    for data in (b"ts\n" + b"".join(b"%d\n" % 7**i for i in range(40)), b"ts\r\n1\r\n\r\n22\r\n333", b"ts\n", b""):
        (tmp_path / "a").write_bytes(data)
        for block in (1, 5, 1000):
            monkeypatch.setattr(files, "BLOCK", block)
            for piece in (1, 2, 7, 1000):
                ends = [*range(piece, len(data), piece), None]
                found = [x for start, end in zip(range(0, max(1, len(data)), piece), ends, strict=True) for x in files._lines(str(tmp_path / "a"), start, end, None)]
                assert [h for h, _ in found if h is not None] == data.decode().split()[:1]
                assert [line for _, some in found for line in some] == data.decode().split()[1:]
