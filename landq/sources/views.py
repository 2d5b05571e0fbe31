"""Land-record frames derived from the given Parquet tables, and the same derivation as SQL text.

The given tables hold no land records, so orders and customers play the records, events the logs, documents the
texts and embeddings the image hashes. Column expressions are written once, in SQL that both engines read.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landq.session import tune

LR = {
    "id": "o_orderkey",
    "survey_number": "concat(cast(o_custkey % 40 + 1 as string), '/', cast(o_orderkey % 9 + 1 as string), "
                     "case when o_orderkey % 97 = 0 then '-Z' when o_orderkey % 3 = 0 then 'A' "
                     "when o_orderkey % 3 = 1 then 'B' else '' end)",
    "khasra_number": "concat('KHA-', cast(o_custkey % 90 as string))",
    "khata_number": "concat('KH-', cast(o_custkey as string))",
    "plot_number": "case when o_orderkey % 6 = 0 then null else concat('PLOT-', cast(o_custkey % 70 as string)) end",
    "owner_name": "c_name",
    "father_husband_name": "case when o_orderkey % 11 = 0 then null "
                           "else concat('Parent ', cast(c_custkey % 50 as string)) end",
    "previous_owner": "case when o_orderkey % 5 = 0 then concat('Prior ', cast(o_custkey % 30 as string)) end",
    "village": "concat('Village ', cast(o_custkey % 6 as string))",
    "tehsil": "c_mktsegment",
    "district": "case when o_orderkey % 101 = 0 then 'Not found' else n_name end",
    "state": "r_name",
    "land_area": "cast((o_orderkey * 37) % 500 as double) / 100",
    "land_classification": "case o_orderpriority when '1-URGENT' then 'Commercial' when '2-HIGH' then 'Industrial' "
                           "when '3-MEDIUM' then 'Agricultural' when '4-NOT SPECIFIED' then 'Unclassified' "
                           "else 'Residential' end",
    "registration_number": "concat('REG/', lpad(cast(o_orderkey - case when o_orderkey % 50 = 1 then 1 else 0 end "
                           "as string), 8, '0'))",
    "registration_date": "concat(lpad(cast(day(o_orderdate) as string), 2, '0'), '-', "
                         "lpad(cast(month(o_orderdate) as string), 2, '0'), '-', cast(year(o_orderdate) as string))",
    "document_type": "case o_orderkey % 4 when 0 then 'Registered Sale Deed' when 1 then 'Khasra / Khatauni Register' "
                     "when 2 then 'Cadastral Boundary Map' else 'Mutation Sanction Order' end",
    "status": "case when o_orderstatus = 'F' then 'APPROVED' when o_orderstatus = 'O' then 'OFFICER_REVIEW' "
              "when o_orderkey % 3 = 0 then 'LOW_CONFIDENCE' when o_orderkey % 3 = 1 then 'VALIDATION_FAILED' "
              "else 'REJECTED' end",
    "verification_status": "case when o_orderstatus = 'F' then 'Verified' end",
    "publication_status": "case when o_orderstatus = 'F' then 'PUBLISHED' else 'DRAFT' end",
    "document_status": "case when o_orderstatus = 'F' then 'Digitized and Verified' else 'Awaiting Officer' end",
    "is_public": "o_orderstatus = 'F' and o_orderkey % 7 <> 0",
    "source_type": "case when o_orderkey % 8 = 3 then 'DOSSIER' else 'HISTORICAL' end",
    "confidence_score": "cast((o_orderkey * 13) % 600 + 400 as double) / 10",
    "updated_at": "o_orderdate",
}
LR_FROM = ("orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey "
           "join region on n_regionkey = r_regionkey")

DEED_TEXT = (
    "concat('GOVERNMENT REGISTER - ', document_type, chr(10), 'Registration No: ', registration_number, ' | Date: ', "
    "registration_date, chr(10), 'Owner: ', owner_name, chr(10), case when father_husband_name is null then '' else "
    "concat('Father Name: ', father_husband_name, chr(10)) end, 'Survey Number: ', case when id % 4 = 0 then "
    "translate(survey_number, '0123456789', '०१२३४५६७८९') else survey_number end, ' | Khasra Number: ', khasra_number, "
    "chr(10), 'Area: ', cast(cast(round(land_area * 100) as int) as string), ' Cents', chr(10), 'Village: ', village, "
    "' | Tehsil: ', tehsil, ' | District: ', district, ' | State: ', state)"
)
# A fuller deed in the layout of each document type, for the typed extractors.
TYPED_TEXT = (
    "concat(document_type, chr(10), "
    "case id % 4 "
    "when 0 then concat('Deed No: ', registration_number, chr(10), 'Date of Registration: ', registration_date, chr(10), "
    "'Vendor: ', coalesce(previous_owner, 'n/a'), chr(10), 'Purchaser: ', owner_name, chr(10), 'Survey No: ', "
    "translate(survey_number, '0123456789', '०१२३४५६७८९'), chr(10), 'Plot No: ', coalesce(plot_number, '-'), chr(10), "
    "'North: Road, West: Plot ', cast(id % 17 as string), chr(10), 'Consideration Amount: Rs. ', cast(id * 7 as string), "
    "chr(10), 'Stamp Duty Paid: Rs. ', cast(id % 900 as string), chr(10), 'SRO: ', tehsil) "
    "when 1 then concat('Khata No: ', khata_number, chr(10), 'Khasra No: ', khasra_number, chr(10), 'Pattadar: ', owner_name, "
    "chr(10), case when father_husband_name is null then '' else concat('S/o: ', father_husband_name, chr(10)) end, "
    "'Classification: ', land_classification) "
    "when 2 then concat('Survey Number: ', survey_number, chr(10), 'Parcel Numbers: ', khasra_number, chr(10), "
    "'Scale: 1:', cast(1000 + id % 7 as string), chr(10), 'Sheet No: ', cast(id % 31 as string), chr(10), "
    "'North Boundary: ', case when id % 3 = 0 then 'Main Road' else 'Canal' end) "
    "else concat('Mutation Case No: ', cast(id as string), '/', cast(id % 30 as string), chr(10), 'Order No: ORD-', "
    "cast(id % 700 as string), chr(10), 'Order Date ', registration_date, chr(10), 'Mouza: Mouzapur', chr(10), "
    "'Tahasildar, ', tehsil, chr(10), 'Survey No ', cast(id % 500 as string), chr(10), 'Khata No ', cast(id % 300 as string), "
    "chr(10), case when id % 3 = 0 then 'registered sale deed verified' when id % 3 = 1 then 'legal heir application' "
    "else 'case disposed' end, chr(10), '0.', lpad(cast(id % 10000 as string), 4, '0'), ' recorded in Odisha') end, "
    "chr(10), 'Area: ', cast(cast(round(land_area * 100) as int) as string), case when id % 4 = 0 then ' Cents' else ' Acres' end, "
    "chr(10), 'Village: ', upper(tehsil), chr(10), 'Tehsil: ', tehsil, chr(10), 'District: ', district, chr(10), 'State: ', state)"
)
# One line per record in a language chosen by id, with native digits.
INDIC_TEXT = (
    "case id % 10 "
    "when 0 then concat('सर्वे संख्या ', translate(survey_number, '0123456789', '०१२३४५६७८९'), ' बैनामा विक्रय पत्र ग्राम') "
    "when 1 then concat('తెలంగాణ ప్రభుత్వం రిజిస్ట్రేషన్ సర్వే నంబరు ', translate(survey_number, '0123456789', '౦౧౨౩౪౫౬౭౮౯')) "
    "when 2 then concat('தமிழ்நாடு அரசு பதிவுத்துறை நில உரிமையாளர் ', owner_name) "
    "when 3 then concat('खरेदीखत गट क्रमांक ', translate(survey_number, '0123456789', '०१२३४५६७८९'), ' खातेदार तालुका') "
    "when 4 then concat('বিক্রয় দলিল দাগ নম্বর ', translate(survey_number, '0123456789', '০১২৩৪৫৬৭৮৯')) "
    "when 5 then concat('মাটিৰ গৰাকী ', owner_name, ' দাগ নম্বৰ') "
    "when 6 then concat('جمع بندی خسرہ نمبر ', cast(id % 90 as string)) "
    "when 7 then concat('Sale Deed ', survey_number, ' క్రయవిక్రయ పత్రము రమేష్ శర్మ ', district) "
    "when 8 then concat('12-', cast(id % 9 as string), ' / 99') "
    "else concat('Registered sale deed of ', owner_name, ', ', village) end"
)

FIELD_COLUMNS = ["owner_name", "father_husband_name", "survey_number", "khasra_number", "land_area", "village", "tehsil",
                 "district", "registration_number", "registration_date"]


def field_value(column: str) -> str:
    """Text of one record column as an extraction would have read it."""
    if column == "land_area":
        return "concat(cast(cast(round(land_area * 100) as int) as string), ' Cents')"
    return f"coalesce({column}, 'Not found')"


def _field_row(ordinal: int, column: str) -> dict[str, str]:
    value = field_value(column)
    return {
        "field_id": f"id * 20 + {ordinal}",
        "land_record_id": "id",
        "field_name": f"'{column}'",
        "ordinal": f"{ordinal}",
        "extracted_value": value,
        "corrected_value": f"case when (id + {ordinal}) % 13 = 0 then "
                           + ("'2.75 Acres'" if column == "land_area" else f"concat({value}, ' rev')") + " end",
        "confidence": f"cast((id * 7 + {ordinal * 31}) % 600 + 400 as double) / 10",
        "requires_review": f"(id + {ordinal}) % 17 = 0",
        "is_verified": f"(id + {ordinal}) % 19 = 0",
        "present": f"(id + {ordinal}) % 7 <> 0",
    }


FIELD_ROWS = [_field_row(i + 1, c) for i, c in enumerate(FIELD_COLUMNS)]

REGISTRATION = {
    "id": "id", "registration_number": "registration_number", "source": "'SRO'", "owner_name": "owner_name",
    "father_husband_name": "father_husband_name", "survey_number": "survey_number",
    "khasra_number": "case when id % 3 = 0 then null else khasra_number end",
    "khata_number": "case when id % 4 = 0 then null else khata_number end",
    "village": "village", "tehsil": "tehsil", "district": "district", "state": "state", "land_area": "land_area",
    "land_classification": "land_classification", "registration_date": "registration_date",
    "expected_public_date": "registration_date",
    "status": "case when id % 4 = 0 then 'PUBLISHED' when id % 4 = 1 then 'RECEIVED' else 'OFFICER_REVIEW' end",
    "confidence_score": "confidence_score", "has_mismatch": "false",
    "land_record_id": "case when id % 6 = 0 then id end", "received_at": "updated_at",
}
CORRECTION = {
    "id": "event_id", "document_id": "event_id % 500",
    "field_name": "case event_type when 'purchase' then 'owner_name' when 'error' then 'survey_number' "
                  "when 'click' then 'village' when 'view' then 'land_area' else 'tenure' end",
    "original_ai_value": "concat('old ', cast(user_id as string))",
    "corrected_value": "case when event_type = 'view' then concat(cast(event_id % 90 as string), '.5 Acres') "
                       "when event_id % 7 = 0 then concat('old ', cast(user_id as string)) "
                       "else concat('new ', cast(event_id % 40 as string)) end",
    "officer_name": "concat('officer_', cast(user_id % 9 as string))",
    "reason": "'Manual correction'",
    "language": "case when event_id % 3 = 0 then 'Hindi' end",
    "document_type": "case when event_id % 4 = 0 then 'Mutation Sanction Order' end",
    "timestamp": "ts",
}
AUDIT = {
    "id": "event_id", "actor": "concat('officer_', cast(user_id as string))", "actor_role": "'OFFICER'",
    "action": "upper(event_type)", "entity_type": "'LAND_RECORD'", "entity_id": "cast(event_id % 500 as string)",
    "timestamp": "ts",
}
ACTION = {
    "event_id": "event_id", "record_id": "event_id % 500",
    "action": "case event_type when 'purchase' then 'APPROVED' when 'error' then 'REJECTED' when 'click' then 'SENT_BACK' "
              "when 'view' then 'SAVE_CHANGES' else 'SYNC_CADASTRAL' end",
    "officer_name": "concat('officer_', cast(user_id % 9 as string))", "ts": "ts",
}
VERIFICATION = {
    "event_id": "event_id", "ts": "ts",
    "language_code": "case event_id % 5 when 0 then 'hi' when 1 then 'te' when 2 then 'xx' when 3 then 'ta' else 'en' end",
    "corrections": "cast(user_id % 6 as bigint)",
}
STATE_SOURCE = {
    "name": "r_name", "code": "substr(r_name, 1, 2)", "capital": "cast(null as string)", "region": "lower(r_name)",
    "survey_label": "case when r_regionkey % 2 = 0 then 'Khasra Number' end",
    "admin_unit_label": "case when r_regionkey % 3 = 0 then 'Mandal' end",
    "default_area_unit": "case when r_regionkey % 3 = 1 then 'Bigha' end",
    "language_code": "case when r_regionkey = 4 then 'hi' end",
}
EVAL_TRUTH = "ocr_raw_text"
EVAL_HYPOTHESIS = (
    f"case when id % 3 = 0 then translate(case when id % 5 = 0 then regexp_replace({EVAL_TRUTH}, ' [^ ]+$', '') "
    f"else {EVAL_TRUTH} end, '0O1l', 'O0l1') when id % 5 = 0 then regexp_replace({EVAL_TRUTH}, ' [^ ]+$', '') "
    f"else {EVAL_TRUTH} end"
)


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in columns.items())


def _bits(first: int) -> str:
    return (f"list_reduce(list_transform(range(1, 33), lambda i: case when embedding[{first} + i] > 0 "
            "then (1::bigint << (32 - i)) else 0::bigint end), lambda a, b: a + b)")


# SQL text of the views: name -> (views it needs, select statement)
VIEW_SQL: dict[str, tuple[list[str], str]] = {
    "lr": ([], f"select {_select(LR)} from {LR_FROM}"),
    "cad": (["lr"], """
        select l.id, l.survey_number, l.village, l.district,
               l.land_area + case when l.id % 2 = 0 then 0.05::double else 0.0::double end as cadastral_area,
               cast(2015 + l.id % 8 as int) as survey_year
        from lr l join (select survey_number, min(id) as id from lr group by 1) f on l.id = f.id
        where l.id % 5 <> 0"""),
    "deed": (["lr"], f"select id, id as doc_id, id as land_record_id, document_type, land_area, {DEED_TEXT} as ocr_raw_text from lr"),
    "typed": (["lr"], f"select id as doc_id, document_type, {TYPED_TEXT} as ocr_raw_text from lr"),
    "indic": (["lr"], f"select id as doc_id, {INDIC_TEXT} as text from lr"),
    "reg": (["lr"], f"select {_select(REGISTRATION)} from lr where status = 'OFFICER_REVIEW'"),
    "fields": (["lr"], " union all ".join(
        "select " + _select({k: v for k, v in row.items() if k != "present"}) + f" from lr where {row['present']}"
        for row in FIELD_ROWS)),
    "corrections": ([], f"select {_select(CORRECTION)} from events"),
    "audit": ([], f"select {_select(AUDIT)} from events"),
    "actions": ([], f"select {_select(ACTION)} from events"),
    "verifications": ([], f"select {_select(VERIFICATION)} from events"),
    "state_source": ([], f"select {_select(STATE_SOURCE)} from region"),
    "district_source": ([], """
        select substr(r_name, 1, 2) as state_code, n_name as district_name,
               case when n_nationkey % 3 = 0 then [concat(n_name, ' North')]
                    else [concat(n_name, ' North'), concat(n_name, ' South')] end as admin_units
        from nation join region on n_regionkey = r_regionkey where n_nationkey % 7 <> 6
        union all select 'ZZ', n_name, ['Nowhere'] from nation where n_nationkey % 7 = 6"""),
    "ocr_lines": (["deed"], """
        select d.doc_id, t.line_no::int as line_no, string_split(d.ocr_raw_text, chr(10))[t.line_no] as text,
               cast(50 + (d.doc_id + t.line_no) % 50 as double) / 100 as confidence,
               (40 + 300 * (t.line_no % 3))::int as x1, (60 * t.line_no)::int as y1, 900 as x2, (60 * t.line_no + 40)::int as y2
        from deed d, unnest(range(1, len(string_split(d.ocr_raw_text, chr(10))) + 1)) as t(line_no)"""),
    "eval_pairs": (["deed"], f"""
        select id, case when id % 3 = 0 then 'Hindi' when id % 3 = 1 then 'English' else 'Telugu' end as language,
               document_type, {EVAL_TRUTH} as truth, {EVAL_HYPOTHESIS} as hypothesis from deed"""),
    "ph0": ([], f"select vec_id, {_bits(0)} as hi, {_bits(32)} as lo from embeddings"),
    "ph": (["ph0"], """
        select v.vec_id, case when p.vec_id is null then v.hi else xor(p.hi, 5::bigint) end as hi,
               case when p.vec_id is null then v.lo else p.lo end as lo
        from ph0 v left join ph0 p on p.vec_id = v.vec_id - 1 and v.vec_id % 20 = 1"""),
    "geo": (["lr"], """
        select id, 77 + (id % 100) / 100.0::double as lon, 23 + (id % 50) / 100.0::double as lat from lr"""),
}


def with_views(sql: str, *names: str) -> str:
    """`sql` behind a WITH list of the named views and all they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEW_SQL[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql
    head = ", ".join(f"{n} as ({VIEW_SQL[n][1]})" for n in ordered)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:]}"
    return f"with {head} {body}"


class Views:
    """The same views as Spark frames; each is a lazy plan over the Parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    @staticmethod
    def _exprs(columns: dict[str, str]) -> list[str]:
        return [f"{e} as {n}" for n, e in columns.items()]

    def spread(self, df: DataFrame) -> DataFrame:
        """A plain scan in fewer splits than there are cores, spread over them; larger tables stay as they are split."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def _records(self, orders: DataFrame) -> DataFrame:
        joined = (orders
                  .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
                  .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                  .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")))
        return joined.selectExpr(*self._exprs(LR))

    @cached_property
    def lr(self) -> DataFrame:
        return self._records(self.table("orders"))

    @cached_property
    def lr_texts(self) -> DataFrame:
        """The records for work that is heavy on each text."""
        return self._records(self.spread(self.table("orders")))

    @cached_property
    def texts(self) -> DataFrame:
        return self.spread(self.table("documents"))

    @cached_property
    def cad(self) -> DataFrame:
        first = self.lr.groupBy("survey_number").agg(
            F.min_by(F.struct("id", "village", "district", "land_area"), "id").alias("r"))
        return first.where("r.id % 5 <> 0").selectExpr(
            "r.id as id", "survey_number", "r.village as village", "r.district as district",
            "r.land_area + case when r.id % 2 = 0 then 0.05D else 0.0D end as cadastral_area",
            "cast(2015 + r.id % 8 as int) as survey_year")

    @cached_property
    def deed(self) -> DataFrame:
        return self.lr_texts.selectExpr("id", "id as doc_id", "id as land_record_id", "document_type", "land_area",
                                  f"{DEED_TEXT} as ocr_raw_text")

    @cached_property
    def typed(self) -> DataFrame:
        return self.lr_texts.selectExpr("id as doc_id", "document_type", f"{TYPED_TEXT} as ocr_raw_text")

    @cached_property
    def indic(self) -> DataFrame:
        return self.lr_texts.selectExpr("id as doc_id", f"{INDIC_TEXT} as text")

    @cached_property
    def reg(self) -> DataFrame:
        return self.lr.where("status = 'OFFICER_REVIEW'").selectExpr(*self._exprs(REGISTRATION))

    @cached_property
    def fields(self) -> DataFrame:
        """A row for each record and ordinal. Every column is an expression of its own, so none that a query doesn't read is made."""
        def of_row(column: str) -> str:
            return "case nth " + " ".join(f"when {row['ordinal']} then {row[column]}" for row in FIELD_ROWS) + " end"

        ordinals = F.array(*[F.lit(int(row["ordinal"])) for row in FIELD_ROWS])
        columns = {c: of_row(c) for c in FIELD_ROWS[0] if c != "present"} | {"land_record_id": "id", "ordinal": "nth"}
        return self.lr_texts.withColumn("nth", F.explode(ordinals)).where(of_row("present")).selectExpr(*self._exprs(columns))

    def _events(self, columns: dict[str, str]) -> DataFrame:
        return self.table("events").selectExpr(*self._exprs(columns))

    @cached_property
    def corrections(self) -> DataFrame:
        return self._events(CORRECTION)

    @cached_property
    def audit(self) -> DataFrame:
        return self._events(AUDIT)

    @cached_property
    def actions(self) -> DataFrame:
        return self._events(ACTION)

    @cached_property
    def verifications(self) -> DataFrame:
        return self._events(VERIFICATION)

    @cached_property
    def state_source(self) -> DataFrame:
        return self.table("region").selectExpr(*self._exprs(STATE_SOURCE))

    @cached_property
    def district_source(self) -> DataFrame:
        nation = self.table("nation")
        known = nation.join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 7 <> 6")
        known = known.selectExpr(
            "substr(r_name, 1, 2) as state_code", "n_name as district_name",
            "case when n_nationkey % 3 = 0 then array(concat(n_name, ' North')) "
            "else array(concat(n_name, ' North'), concat(n_name, ' South')) end as admin_units")
        stray = nation.where("n_nationkey % 7 = 6").selectExpr(
            "'ZZ' as state_code", "n_name as district_name", "array('Nowhere') as admin_units")
        return known.unionByName(stray)

    @cached_property
    def ocr_lines(self) -> DataFrame:
        lines = self.deed.select("doc_id", F.posexplode(F.split("ocr_raw_text", "\n")).alias("pos", "text"))
        return lines.selectExpr(
            "doc_id", "pos + 1 as line_no", "text",
            "cast(50 + (doc_id + pos + 1) % 50 as double) / 100 as confidence",
            "40 + 300 * ((pos + 1) % 3) as x1", "60 * (pos + 1) as y1", "900 as x2", "60 * (pos + 1) + 40 as y2")

    @cached_property
    def eval_pairs(self) -> DataFrame:
        return self.deed.selectExpr(
            "id", "case when id % 3 = 0 then 'Hindi' when id % 3 = 1 then 'English' else 'Telugu' end as language",
            "document_type", f"{EVAL_TRUTH} as truth", f"{EVAL_HYPOTHESIS} as hypothesis")

    @cached_property
    def ph(self) -> DataFrame:
        def bits(first: int) -> str:
            return (f"aggregate(transform(sequence(1, 32), i -> case when element_at(embedding, {first} + i) > 0 "
                    "then shiftleft(1L, 32 - i) else 0L end), 0L, (a, b) -> a + b)")
        base = self.table("embeddings").selectExpr("vec_id", f"{bits(0)} as hi", f"{bits(32)} as lo")
        prior = base.selectExpr("vec_id + 1 as vec_id", "hi as p_hi", "lo as p_lo").where("vec_id % 20 = 1")
        return base.join(prior, "vec_id", "left").selectExpr(
            "vec_id", "case when p_hi is null then hi else p_hi ^ 5L end as hi", "coalesce(p_lo, lo) as lo")

    @cached_property
    def geo(self) -> DataFrame:
        return self.lr.selectExpr("id", "77 + (id % 100) / 100.0D as lon", "23 + (id % 50) / 100.0D as lat")
