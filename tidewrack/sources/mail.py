"""Mail API dumps to records: body, subject, bare address, time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.functions.text import base64url_text, first_present, html_text, without_history
from tidewrack.operators.timestamps import epoch_ms, header_value

_BODY = "array<struct<mime:string,data:string>>"


def leaf_parts(payload: Column, dtype: T.StructType) -> Column:
    """(mime, data) of a payload and all its parts, depth first, to the depth that its type has."""
    here = F.array(F.struct(payload["mimeType"].alias("mime"), payload["body"]["data"].alias("data")))
    if "parts" not in dtype.names:
        return here
    inner = dtype["parts"].dataType.elementType
    below = F.flatten(F.transform(payload["parts"], lambda p: leaf_parts(p, inner)))
    return F.concat(here, F.coalesce(below, F.array().cast(_BODY)))


def mail_records(mails: DataFrame) -> DataFrame:
    """id, source, sender, epoch_ms, text: the plain part (else the HTML part without tags), without history and signature, after its subject.

    Without such a body the snippet stands in; mails without either are dropped. The sender is the bare address, else
    the header, else ``unknown``. Times are those of internalDate, else of the Date header.
    """
    parts = F.filter(leaf_parts(F.col("payload"), mails.schema["payload"].dataType), lambda p: F.coalesce(p["data"], F.lit("")) != "")
    part = lambda mime: F.get(F.filter(F.col("_parts"), lambda p: p["mime"] == mime), F.lit(0))["data"]
    x = mails.withColumn("_parts", parts)
    body = F.coalesce(base64url_text(part("text/plain")), html_text(base64url_text(part("text/html"))))
    x = x.withColumn("_body", first_present(without_history(body), F.btrim("snippet")))
    headers = F.col("payload.headers")
    sender = header_value(headers, "from")
    address = F.regexp_extract(sender, "<([^>]+)>", 1)
    subject = F.btrim(F.coalesce(header_value(headers, "subject"), F.lit("")))
    text = F.when(subject != "", F.concat(F.lit("Subject: "), subject, F.lit("\n\n"), F.col("_body"))).otherwise(F.col("_body"))
    return x.where(F.coalesce(F.col("_body"), F.lit("")) != "").select(
        "id", F.lit("email").alias("source"), F.coalesce(first_present(address, F.btrim(sender)), F.lit("unknown")).alias("sender"),
        F.coalesce(epoch_ms(F.col("internalDate")), epoch_ms(header_value(headers, "date"))).alias("epoch_ms"), text.alias("text"),
    )
