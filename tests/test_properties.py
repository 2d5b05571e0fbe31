"""Algorithms against brute force on small fixtures, with hot keys and groups of copies planted."""

import datetime
import random
import time
from itertools import combinations

from pyspark.sql import functions as F

from landq import schemas
from landq.functions.distance import distance
from landq.operators import crossdoc, duplicates, filters, lookup, similarity, telemetry, workflow
from landq.sources.views import Views
from landq.streaming import review

FOLDER = "/root/testdata/sf0.001"


def jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b)


def texts():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(60)] + ["deed", "survey", "owner"] * 5
    out = []
    for _ in range(60):
        out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 60))))
    base = " ".join(f"common{i}" for i in range(40))
    for i in range(60):  # near copies of one text: a third of the rows
        out.append(base + f" tail{i} tail{i + 1}")
    out += [base] * 10 + [out[0]] * 3
    for t in out[:20]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out


def test_similar_texts_equals_brute_force(spark):
    rows = [(i, i // 2 if i % 5 == 0 else i + 1000, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, land_record_id bigint, ocr_raw_text string")
    want = set()
    for (i, r1, a), (j, r2, b) in combinations(rows, 2):
        if len(a) > 50 and len(b) > 50 and r1 != r2 and jaccard(a, b) > 0.85:
            want |= {i, j}
    for full in (64, 3, 1):  # few keys to lengthen, and almost all
        got = {r.doc_id for r in similarity.similar_texts(docs, full=full).collect()}
        assert got == want


def test_one_word_in_all_texts_makes_few_pairs(spark):
    """Texts that differ but for one word never meet over it: their prefixes hold rarer words; keys of the rest get longer."""
    rng = random.Random(9)
    rows = [(i, None, "deed " + " ".join(f"w{rng.randrange(40)}x{j}" for j in range(12))) for i in range(4000)]
    rows += [(4000 + i, None, rows[i][2] + " extra") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, land_record_id bigint, ocr_raw_text string")
    words = {i: set(t.split()) for i, _, t in rows}
    want = {k for i in range(30) for k in (i, 4000 + i)}
    assert all(len(words[i] & words[4000 + i]) / len(words[4000 + i]) > 0.85 for i in range(30))
    assert {r.doc_id for r in similarity.similar_texts(docs).collect()} == want


def test_edit_distance():
    rng = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in "ab")
        assert distance(a, b) == distance("".join(a), "".join(b)) == plain(a, b)
    words = [f"w{rng.randrange(500)}" for _ in range(20_000)]
    other = [w for w in words if rng.random() > 0.05]
    begin = time.monotonic()
    assert distance(words, other) == len(words) - len(other) and time.monotonic() - begin < 10


def test_blank_district_finds_registry_rows_without_one(spark):
    """The registration number alone is asked for where no district is given; a given district never meets a missing one."""
    shape = "id bigint, registration_number string, district string, owner_name string, status string"
    registry = spark.createDataFrame([(1, "R1", None, "A", "APPROVED"), (2, "R2", "Guna", None, "APPROVED"), (3, "R3", None, "C", None)], shape)
    incoming = spark.createDataFrame([(11, "r1", "", "X", ""), (12, "R2", None, "X", ""), (13, "R3", "Guna", "X", ""), (14, "R2", "una", "X", "")], shape)
    got = {r.id: (r.match_id, r.detail) for r in duplicates.same_registration(incoming, registry).collect()}
    assert {i: m for i, (m, _) in got.items()} == {11: 1, 12: 2, 14: 2} and got[12][1] is not None


def test_documents_of_one_record_do_not_count(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, 7, text), (2, 7, text + " x"), (3, None, "other " * 20), (4, None, "other " * 20)],
                                 "doc_id bigint, land_record_id bigint, ocr_raw_text string")
    assert {r.doc_id for r in similarity.similar_texts(docs).collect()} == {3, 4}


def test_similar_hashes_equals_brute_force(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in values[:40]:
        for bit in rng.sample(range(64), rng.randint(0, 8)):
            v ^= 1 << bit
        values.append(v)
    values += [0] * 60 + [1 << b for b in range(20)]
    rows = [(i, i, f"{v:016x}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id bigint, land_record_id bigint, phash string")
    halves = df.select("doc_id", "land_record_id", *similarity.hash_halves("phash"))
    want = {k for (i, a), (j, b) in combinations(enumerate(values), 2) if (a ^ b).bit_count() <= 6 for k in (i, j)}
    for bands, full in ((8, 64), (9, 64), (None, 4), (8, 1)):
        assert {r.doc_id for r in similarity.similar_hashes(halves, bands=bands, full=full).collect()} == want


def test_bands_follow_the_number_of_hashes():
    assert [similarity.bands_for(n) for n in (100, 10 ** 6, 10 ** 9)] == [8, 8, 11]


def test_first_containing_equals_brute_force(spark):
    rng = random.Random(11)
    names = ["ram", "rampur", "rampur kalan", "pur", "kala", "kalan", "Ram", "sita pur", ""]
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", rng.choice(names) + (str(i % 20) if i % 2 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, key string, name string")
    want = {}
    for i, k, n in rows:
        others = [j for j, k2, n2 in rows if k2 == k and j != i and n.strip().lower() in n2.lower()]
        if others:
            want[i] = min(others)
    for small in (1000, 2):  # all keys direct; hot keys by pieces
        got = {r.id: r.match.id for r in lookup.first_containing(df, df, "key", "name", small_group=small).collect()}
        assert got == want


def test_lowest_two_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.struct("id").alias("entry"))
    plan = lookup.lowest_two(df, ["k"], "entry")
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
    assert {r.k: [e.id for e in r.firsts] for r in plan.collect()} == {0: [0, 3], 1: [1, 4], 2: [2, 5]}


def test_telemetry_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hi", "en", "en", "en", "zz"]), rng.randint(0, 6)) for i in range(3000)]
    log = spark.createDataFrame(rows, "event_id bigint, language_code string, corrections bigint").withColumn("ts", F.timestamp_seconds(F.floor(F.col("event_id") / 50)))
    state = {"hi": [9240, 0, 0], "en": [9650, 0, 0]}
    for _, code, c in rows:
        s = state["hi" if code == "hi" else "en"]
        s[1] += 1
        s[2] += c
        s[0] = max(8000, min(9940, s[0] + 5 * s[1] - 2 * s[2]))
    got = {r.code: [r.accuracy, r.processed, r.corrections] for r in telemetry.language_telemetry(log, chunks=7).collect()}
    assert got["hi"] == state["hi"] and got["en"] == state["en"]
    first = telemetry.language_telemetry(log.where("event_id < 1300"), chunks=3)
    again = {r.code: [r.accuracy, r.processed, r.corrections] for r in telemetry.language_telemetry(log.where("event_id >= 1300"), first, chunks=5).collect()}
    assert again["hi"] == state["hi"] and again["en"] == state["en"]


def verifications(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, language_code string, corrections bigint")


def delivered(spark, parts, delay, folder):
    """The telemetry after the parts came one by one, each to a query that was started anew."""
    for part in parts:
        verifications(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        stream = review.read_events(spark, f"{folder}/events", schemas.VERIFICATION, 1)
        review.stream_language_telemetry(stream, f"{folder}/state", f"{folder}/checkpoint", delay).trigger(availableNow=True).start().awaitTermination()
    return {r.code: tuple(r)[2:] for r in review.telemetry_after(spark, f"{folder}/state").collect()}


def test_stream_telemetry_follows_event_time(spark, tmp_path):
    """Shuffled files, restarts and a settled state give what the whole log gives; values stay between the limits and at them."""
    begin = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, begin + datetime.timedelta(hours=i // 3), ("hi", "en", "te", "xx")[i % 4], 40 if i % 4 == 2 else 3 if i % 8 in (0, 1, 5) else 2) for i in range(600)]
    want = {r.code: tuple(r)[2:] for r in telemetry.language_telemetry(verifications(spark, rows)).collect()}
    assert [8000 < want[code][0] < 9940 for code in ("hi", "en", "te")] == [True, True, False]
    mixed = [rows[i::4] for i in (2, 0, 3, 1)]
    assert {k: v[:3] for k, v in delivered(spark, mixed, "400 days", tmp_path / "a").items()} == want
    ordered = delivered(spark, [rows[i:i + 150] for i in range(0, 600, 150)], "1 day", tmp_path / "b")
    assert {k: v[:3] for k, v in ordered.items()} == want
    assert sum(v[3] for v in ordered.values()) < 200  # only what the watermark has not passed is kept


def test_public_records_hold_nothing_else(spark):
    v = Views(spark, FOLDER)
    assert filters.public_records(v.lr, limit=None).where("status not in ('APPROVED', 'PUBLISHED', 'USER_VERIFIED') or not is_public").isEmpty()


def test_actions_twice_are_actions_once(spark):
    v = Views(spark, FOLDER)
    once = workflow.apply_actions(v.lr, v.actions, v.cad)
    twice = workflow.apply_actions(once, v.actions, v.cad)
    assert once.exceptAll(twice).isEmpty()


def test_same_number_and_other_owner_is_a_duplicate(spark):
    columns = "id bigint, registration_number string, survey_number string, khasra_number string, village string, district string, owner_name string, land_area double, status string"
    registry = spark.createDataFrame([(1, "SAN-2025/0418", "57/2B", "K9", "Chandpura Khurd", "Indore", "Harish", 1.8, "APPROVED")], columns)
    incoming = spark.createDataFrame([(9, "san-2025/0418", "57/2B", None, "chandpura", "Indore", "Gopal Rao", 1.8, "RECEIVED"),
                                      (10, "none", "1/1", None, "x", "y", "z", 1.0, "RECEIVED")], columns)
    got = {r.id: r for r in duplicates.risk_score(incoming, duplicates.record_vectors(incoming, registry)).collect()}
    assert got[9].risk_score == 70 and got[9].is_duplicate and got[9].risk_level == "HIGH" and got[9].requires_officer_review
    assert got[10].risk_score == 0 and got[10].risk_level == "LOW"


def test_dossier_statuses(spark):
    from difflib import SequenceMatcher
    matrix = spark.createDataFrame([
        ("d", 0, "survey_number", "x", 2, "12/3", "12/3", "Document not uploaded", "Not found"),
        ("d", 2, "owner_name", "x", 2, "Ramesh Sharma", "Ramesh Sharmaa", "Document not uploaded", "Not found"),
        ("d", 4, "new_owner", "x", 2, "Ramesh", "Kailash Nath", "Document not uploaded", "Document not uploaded"),
        ("d", 5, "land_area", "x", 2, "2.45 Acres", "2.40 Acres", "Document not uploaded", "Document not uploaded"),
        ("d", 6, "village", "x", 2, "Rampur", "Document not uploaded", "Document not uploaded", "Not found")],
        "dossier string, field_no int, field_key string, field_label string, documents bigint, sale_deed string, khasra string, cadastral string, mutation string")
    done = crossdoc.evaluate_fields(matrix)
    got = {r.field_key: r for r in done.collect()}
    assert {k: r.status for k, r in got.items()} == {"survey_number": "GREEN", "owner_name": "YELLOW", "new_owner": "RED", "land_area": "RED", "village": "YELLOW"}
    assert abs(got["new_owner"].similarity - SequenceMatcher(None, "ramesh", "kailash nath").ratio()) < 1e-9
    total = crossdoc.dossier_summary(done).first()
    assert (total.match_count, total.mismatch_count, total.missing_count, total.overall_status) == (1, 2, 2, "RED")


def test_late_and_repeated_registrations(spark, tmp_path):
    from landq.streaming.registrations import read_registrations, stream_unique_registrations
    v = Views(spark, FOLDER)
    rows = v.reg.limit(5).withColumn("received_at", F.lit("2024-01-10").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))

    def drain():
        stream = stream_unique_registrations(read_registrations(spark, str(tmp_path / "in" / "*"), 1), "1 day")
        q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()
    assert drain() == 5
    rows.coalesce(1).write.parquet(str(tmp_path / "in" / "b"))  # repeats, after a restart
    late = v.reg.where("id % 2 = 1").limit(2).withColumn("registration_number", F.concat(F.lit("late"), "registration_number"))
    late.withColumn("received_at", F.lit("2020-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / "c"))
    assert drain() == 5


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """A batch whose commit was lost runs again and overwrites its own part: actions and telemetry stay as they were."""
    v = Views(spark, FOLDER)
    folder = str(tmp_path)
    v.actions.write.parquet(f"{folder}/actions")
    v.verifications.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{folder}/events")

    def run_all():
        for name, schema, start in (("actions", schemas.ACTION, review.stream_apply_actions), ("events", schemas.VERIFICATION, review.stream_language_telemetry)):
            stream = review.read_events(spark, f"{folder}/{name}", schema)
            start(stream, f"{folder}/{name}-state", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()
        records = review.records_after(f"{folder}/actions-state", v.lr, v.cad).select("id", "status", "land_area")
        return sorted(map(str, records.collect())), sorted(map(str, review.telemetry_after(spark, f"{folder}/events-state").collect()))
    before = run_all()
    for name in ("actions", "events"):
        commits = tmp_path / f"{name}-checkpoint" / "commits"
        last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
        for lost in (commits / str(last), commits / f".{last}.crc"):
            lost.unlink(missing_ok=True)
    assert run_all() == before


def test_read_json_records(spark, tmp_path):
    from landq.sources import land
    path = tmp_path / "records.json"
    path.write_text('[{"owner_name": "A", "land_area": 2.45, "is_public": true, "coordinates_geojson": {"type": "Polygon", "coordinates": [[[77.4, 23.2], [77.5, 23.2], [77.4, 23.2]]]}}]')
    row = land.read_land_records(spark, str(path)).first()
    assert row.owner_name == "A" and row.coordinates_geojson.coordinates[0][1] == [77.5, 23.2]


def test_stream_of_actions_does_not_depend_on_its_batches(spark):
    from landq.session import shared_folder
    from landq.streaming import review
    v = Views(spark, "/root/testdata/sf0.001")
    folder = shared_folder(spark, "shuffled-actions")
    v.actions.repartition(8, F.rand(5)).write.parquet(f"{folder}/actions")
    out = []
    for n in (100, 1):
        stream = review.read_events(spark, f"{folder}/actions", files_per_batch=n)
        review.stream_apply_actions(stream, f"{folder}/last{n}", f"{folder}/checkpoint{n}").trigger(availableNow=True).start().awaitTermination(120)
        rows = review.records_after(f"{folder}/last{n}", v.lr, v.cad).select("id", "status", "is_public", "land_area").collect()
        out.append(sorted(map(tuple, rows)))
    want = workflow.apply_actions(v.lr, v.actions, v.cad).select("id", "status", "is_public", "land_area").collect()
    assert out[0] == out[1] == sorted(map(tuple, want))


def test_stream_telemetry_state_is_by_the_hour(spark, tmp_path):
    """An hour's verifications are one value of the state: rows that repeat or come late give what the loop gives."""
    begin = datetime.datetime(2023, 12, 31, 20, 30, tzinfo=datetime.timezone.utc)
    rows = [(i, begin + datetime.timedelta(minutes=i), "hi", i % 4) for i in range(900)] + [(5, begin + datetime.timedelta(minutes=5), "hi", 1)] * 2
    accuracy, processed, corrections = 9240, 0, 0
    for _, _, _, c in sorted(rows, key=lambda r: (r[1], r[0])):
        processed, corrections = processed + 1, corrections + c
        accuracy = max(8000, min(9940, accuracy + 5 * processed - 2 * corrections))
    got = delivered(spark, [rows[i::3] for i in (2, 0, 1)], "2 days", tmp_path)["hi"]
    assert got == (accuracy, processed, corrections, 900)

    class Once:
        """A state that counts its writes."""
        def __init__(self):
            self.held, self.writes = {}, 0

        def updateValue(self, key, value):
            self.held[key], self.writes = value, self.writes + 1

        getValue = lambda self, key: self.held[key]
        containsKey = lambda self, key: key in self.held
    fold = review.LanguageFold()
    fold.pending = Once()
    fold._keep({0: {(i, i): (1, 1) for i in range(1000)}})
    assert fold.pending.writes == 1 and len(fold._waiting(0)) == 1000


def test_words_are_ranked_without_a_shuffle_of_texts(spark):
    """Rare words come first, in the same order in all texts, from counters of fixed size in place of a join by word."""
    docs = spark.createDataFrame([(i, f"common word{i % 3} only{i}") for i in range(9)], "doc_id bigint, text string")
    sets = docs.select("doc_id", similarity.word_set("text").alias("words"))
    ranked = sets.select("doc_id", "words", similarity.by_rarity(similarity.rarity(sets)).alias("ranked"))
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
    common, = spark.range(1).select(F.xxhash64(F.lit("common"))).first()
    for r in ranked.collect():
        assert sorted(r.words) == sorted(r.ranked) and r.ranked[-1] == common


def test_shared_elements_are_found_by_halving():
    from landq.functions.distance import shared
    asked = []
    assert shared(1_000_000, lambda x, y: asked.append(y) or y <= 765_432) == 765_432 and len(asked) <= 21


def test_classified_text_is_lowered_once(spark):
    from landq.operators.dictionary import classify_document
    texts = spark.createDataFrame([(1, "Sale DEED, vendor and Vendor"), (2, None), (3, "KHASRA and khata"), (4, "")], "id int, t string")
    found = texts.select("id", classify_document(F.col("t")).alias("c"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2
    assert [(r["id"], r["c"]["detected_type"]) for r in found.orderBy("id").collect()] == [
        (1, "Registered Sale Deed"), (2, "Registered Sale Deed"), (3, "Khasra / Khatauni Register"), (4, "Registered Sale Deed")]


def test_labels_are_looked_for_where_they_can_start():
    import re

    from landq import patterns
    from landq.operators.extract import led
    text = "İ no. villages; VILLAGE: Rampur\nmouza=x, 12-3-2020 श्री, Owner - Ram"
    for table in (patterns.SALE_DEED, patterns.KHASRA, patterns.CADASTRAL_MAP, patterns.MUTATION_ORDER):
        for pattern in (p for alternatives in table.values() for p in alternatives):
            plain, ahead = (re.search(p.replace(r"\p{L}\p{M}\p{N}", r"\w"), text, re.I | re.A) for p in (pattern, led(pattern)))
            assert (plain and plain.span()) == (ahead and ahead.span()), pattern
    assert led(patterns.SALE_DEED["village"][0]).startswith("(?=[") and led(patterns.MUTATION_ORDER["order_date"][0]).startswith(r"(?=[0-9])\b")


def test_routed_texts_make_the_rows_of_their_kind_only(spark):
    from landq import dims
    from landq.operators.extract import route_and_score
    texts = spark.createDataFrame([(1, "Sale deed", "Village: Rampur"), (2, "mutation", "Order No 7\n0.25 Acres\nB RAO\nTahasildar"), (3, None, None)],
                                  "doc_id int, document_type string, ocr_raw_text string")
    rows = route_and_score(texts)
    assert "Filter" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["doc_id"], r["field_name"]): r["value"] for r in rows.collect()}
    assert got[1, "village"] == "Rampur" and got[2, "order_number"] == "7" and got[2, "land_area"].startswith("0.25 Acres")
    assert {d: sum(k[0] == d for k in got) for d in (1, 2, 3)} == {1: 25, 2: 19, 3: 25}
    assert {r["document_type"] for r in rows.select("document_type").collect()} == {dims.SALE_DEED, dims.MUTATION_ORDER}


def test_fields_are_not_sorted_to_be_marked(spark):
    fields = spark.createDataFrame([(1, 7, False, True), (2, 7, True, True), (3, 8, False, True), (4, None, True, False), (4, None, True, False)],
                                   "field_id int, land_record_id int, is_verified boolean, requires_review boolean")
    approved = spark.createDataFrame([(7,), (7,), (None,)], "id int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = workflow.mark_fields_verified(fields, approved)
        got = sorted((r.field_id, r.is_verified, r.requires_review) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(1, True, False), (2, True, False), (3, False, True), (4, True, False), (4, True, False)]
    assert "SortMergeJoin" not in plan
