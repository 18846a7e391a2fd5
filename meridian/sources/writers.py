"""Writers: JSON, CSV with plain letters, spreadsheets (one or several sheets), partitioned tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions.text import ascii_fold

#: Rows of a spreadsheet come to the driver; more than this are an error.
SHEET_ROWS = 100_000


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def stream_json(df: DataFrame) -> Iterator[str]:
    """One JSON object at a time; a partition at most is in memory."""
    for row in df.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        yield row["line"]


def plain_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Accented letters without their accents, as old readers want them."""
    df.select(*[ascii_fold(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema]).write.mode("overwrite").option("header", header).csv(path)


def by_cycle(df: DataFrame, path: str, cycle: str = "cycle") -> None:
    """Partitioned by cycle; only the cycles in df are replaced."""
    df.repartition(F.col(cycle)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(cycle).parquet(path)


def table_diff_files(changes: DataFrame, new: DataFrame, key: str, path: str) -> None:
    """inserts, updates and deletes of a difference, each in its folder."""
    for kind in ("insert", "update"):
        new.join(changes.filter(F.col("change") == kind).select(key), key, "left_semi").write.mode("overwrite").parquet(f"{path}/{kind}s")
    changes.filter("change = 'delete'").select(key).write.mode("overwrite").parquet(f"{path}/deletes")


def workbook(sheets: dict[str, DataFrame], most: int = SHEET_ROWS) -> bytes:
    """A spreadsheet file with a sheet for each DataFrame, written with the standard library alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, name in enumerate(names):
            df = sheets[name]
            rows = df.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"{name}: more than {most} rows")
            cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [df.columns, *rows])
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
