"""Names, sentinels and schemas of the tables that the jobs read and write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What sinks write for a value that is not there, and for one that cannot be read. Inside the plans both are NULL or text of the document.
MISSING = "отсутствует"
GARBAGE = "неразборчиво"

#: The business fields, in the order of reports.
FIELDS = ["date", "number", "shipper", "consignee", "cargo", "volume", "driver", "vehicle", "reception"]
ROLES = ["head", "shipper", "consignee", "cargo", "carrier", "vehicle", "reception"]

CONFIDENCE = T.StructType([T.StructField(f, T.DoubleType()) for f in FIELDS])
ROW = T.StructType([T.StructField(f, T.StringType()) for f in ("waybill", *FIELDS, "source", "note")] + [T.StructField("confidence", CONFIDENCE)])
SPAN = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
CORRECTION = "source string, field string, original string, corrected string, original_confidence double, kind string, timestamp string, excel_row int, context string"
SNAPSHOT_ROW = T.StructType([T.StructField("source", T.StringType())] + [x for f in FIELDS for x in (T.StructField(f, T.StringType()), T.StructField(f"{f}_conf", T.DoubleType()))] + [T.StructField("overall_confidence", T.DoubleType()), T.StructField("waybill", T.StringType()), T.StructField("note", T.StringType())])

#: Expert files: documents of one shape, or pages whose fields stand apart. Numbers stay as they are written.
_ORGANISATION = "name:string,legal_form:string,inn:string,kpp:string,address:string,phone:string"
_PLACE = f"struct<infrastructure_owner:struct<{_ORGANISATION}>>"
_PLACES = "places_count:string,net_weight_t:string,volume_m3:string"
EXPERT_DOCUMENTS = f"array<struct<type:string,number:string,date:string,parties:array<struct<role:string,{_ORGANISATION},driver:struct<short_name:string,full_name:string>>>,transport:struct<vehicle_make:string,vehicle_reg_plate:string>,cargo_header:struct<description:string,{_PLACES}>,loading:{_PLACE},unloading:{_PLACE}>>"
EXPERT_PAGES = f"array<struct<document_type:string,structured_fields:struct<ttn_internal_number:string,order_number:string,ttn_date:string,consignor:struct<{_ORGANISATION}>,consignee:struct<{_ORGANISATION}>,carrier_driver:string,vehicle:struct<brand:string,plate:string>,cargo:struct<name:string,{_PLACES}>,loading_point:struct<loader:string,loader_inn:string>>>>"


def is_blank(c: Column) -> Column:
    """Whether a value is NULL, empty or a sentinel."""
    return F.coalesce(c.isin("", MISSING, GARBAGE), F.lit(True))


def shown(c: Column) -> Column:
    """The value as sinks write it."""
    return F.coalesce(c, F.lit(MISSING))
