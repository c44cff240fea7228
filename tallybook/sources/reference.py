"""Reading and writing: document files, reference data as JSON, flat lines, JSON lines, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPLIER = "supplier_id string, legal_name string, aliases array<string>, tax_identifier string, addresses array<string>, default_currency string, active boolean, approved_for_payment boolean"
ORDER = "purchase_order_id string, purchase_order_number string, supplier_id string, currency string, order_date string, total_amount string, lines array<struct<line_number:int,description:string,quantity:string,unit_price:string,line_total:string,item_code:string>>, state string, requires_goods_receipt boolean"
RECEIPT = "goods_receipt_id string, goods_receipt_number string, purchase_order_number string, supplier_id string, receipt_date string, lines array<struct<receipt_line_number:int,purchase_order_line_number:int,quantity_received:string,item_code:string,description:string>>, state string"
DEFAULTS = {"active": True, "approved_for_payment": True, "state": "OPEN", "requires_goods_receipt": True}


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each PDF, PNG, JPEG or TIFF file below path: path, length, content, sha256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF,png,PNG,jpg,JPG,jpeg,JPEG,tif,TIF,tiff,TIFF}").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("sha256", F.sha2("content", 256))


def _defaults(df: DataFrame, **more) -> DataFrame:
    for c, v in (DEFAULTS | more).items():
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(c, F.lit(v)))
    for c in ("aliases", "addresses"):
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return df


def suppliers(spark: SparkSession, path: str) -> DataFrame:
    return _defaults(spark.read.schema(SUPPLIER).json(path, multiLine=True))


def orders(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Orders with typed amounts; what does not parse is null. One JSON array a file, or one object a line."""
    raw = _defaults(spark.read.schema(ORDER).json(path, multiLine=multi_line))
    return raw.withColumn("total_amount", F.col("total_amount").try_cast("decimal(18,2)")).withColumn("order_date", F.col("order_date").try_cast("date"))


def receipts(spark: SparkSession, path: str) -> DataFrame:
    return _defaults(spark.read.schema(RECEIPT).json(path, multiLine=True), state="POSTED").withColumn("receipt_date", F.col("receipt_date").try_cast("date"))


def order_lines(table: DataFrame, *carried: str) -> DataFrame:
    """One row for each line of an order, with the order's number and the carried columns."""
    out = table.select("purchase_order_number", *carried, F.inline("lines"))
    return out.withColumn("quantity", F.col("quantity").try_cast("decimal(18,4)")).withColumn("unit_price", F.col("unit_price").try_cast("decimal(18,2)")).withColumn("line_total", F.col("line_total").try_cast("decimal(18,2)"))


def receipt_lines(table: DataFrame) -> DataFrame:
    return table.select("goods_receipt_id", "purchase_order_number", F.inline("lines")).withColumn("quantity_received", F.col("quantity_received").try_cast("decimal(18,4)"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path, compression="gzip")


def write_results(rows: DataFrame, path: str) -> None:
    """Append under batch_id=/version=, the layout that equality filters prune."""
    rows.write.partitionBy("batch_id", "version").mode("append").parquet(path)


def completeness_code(files: DataFrame) -> DataFrame:
    """document_files rows (with declared media_type) and the first upload fault, or null."""
    head, tail = F.hex(F.substring("content", 1, 16)), F.hex(F.substring("content", F.greatest(F.lit(1), F.length("content") - 63), F.lit(64)))
    trimmed = F.regexp_replace(tail, "(00)+$", "")
    seen = F.when(head.startswith("255044462D"), "application/pdf").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    told = F.when(ext == "pdf", "application/pdf").when(ext == "png", "image/png").when(ext.isin("jpg", "jpeg"), "image/jpeg")
    whole = F.when(seen == "application/pdf", tail.contains("2525454F46")).when(seen == "image/png", head.substr(25, 8).eqNullSafe(F.lit("49484452")) & trimmed.endswith("49454E44AE426082")).otherwise(trimmed.endswith("FFD9"))
    declared = F.lower(F.trim(F.substring_index(F.coalesce("media_type", F.lit("")), ";", 1)))
    return files.withColumn("fault", F.when(F.length("content") == 0, "EMPTY_FILE").when(F.length("content") > 25 * 1024 * 1024, "FILE_TOO_LARGE").when((declared != "") & ~declared.eqNullSafe(told), "MEDIA_TYPE_MISMATCH").when(seen.isNull(), "UNSUPPORTED_FILE_TYPE").when(~seen.eqNullSafe(told), "FILE_SIGNATURE_MISMATCH").when(~whole, "MALFORMED_FILE"))
