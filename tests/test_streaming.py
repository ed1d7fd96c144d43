"""Reports rated as they arrive equal those rated at once."""

from pyspark.sql import functions as F

from sharpsieve.operators.rating import rate
from sharpsieve.schema import REPORT, REPORT_DDL
from sharpsieve.streaming.ratings import rated_stream, write_rated


def test_rated_stream(spark, tmp_path):
    value = {"double": "0.5D * id", "string": "'low'", "int": "cast(id as int)", "bigint": "id"}
    ddl = dict(part.strip().split(" ", 1) for part in REPORT_DDL.split(", "))
    struct = lambda t: "named_struct(" + ", ".join(f"'{f.split(':', 1)[0]}', cast({value.get(f.split(':', 1)[1], 'null')} as {f.split(':', 1)[1]})" for f in t[7:-1].split(",") if ":" in f and "<" not in f) + ")"
    columns = []
    for k, t in ddl.items():
        if k == "detection":
            columns.append("named_struct('box', cast(null as struct<x:double,y:double,w:double,h:double>), 'source', 'none', 'confidence', 'none', 'note', '') as detection")
        elif k == "reasons":
            columns.append("cast(array('loaded') as array<string>) as reasons")
        elif t.startswith("struct"):
            columns.append(f"{struct(t)} as {k}")
        else:
            columns.append(f"cast({value.get(t, 'null') if k not in ('rating', 'label', 'error', 'group_id', 'group_rank') else 'null'} as {t}) as {k}")
    rows = spark.range(60).selectExpr(*columns)
    rows.where("file_idx < 30").write.parquet(str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    write_rated(rated_stream(spark, str(tmp_path / "in")), out, mark, once=True).awaitTermination()
    rows.where("file_idx >= 30").write.mode("append").parquet(str(tmp_path / "in"))
    write_rated(rated_stream(spark, str(tmp_path / "in")), out, mark, once=True).awaitTermination()
    got = {r.file_idx: (r.rating, r.label, r.reasons) for r in spark.read.parquet(out).collect()}
    alone = rows.withColumns({"group_rank": F.lit(None).cast("int"), "group_size": F.lit(1)})
    assert got == {r.file_idx: (r.rating, r.label, r.reasons) for r in rate(alone).collect()} and len(got) == 60 and set(REPORT) <= set(spark.read.parquet(out).columns)
