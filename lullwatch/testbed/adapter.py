"""The driver's tables seen as a sensor journal, so that every program can be checked on them.

Customers are channels, nations and regions are objects, events are journal messages, orders are dispatcher decisions
and work orders. All tables are read whole. Long chains are cut at written stages, as in production.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullwatch.functions.risk import health, risk_level
from lullwatch.functions.values import classify_values
from lullwatch.operators.columns import by_shuffle
from lullwatch.plans import features as X
from lullwatch.plans import journal as J
from lullwatch.session import write_stage
from lullwatch.spec import JournalSpec

SPEC = replace(
    JournalSpec(),
    fault="FAULT", disconnected="DISCONNECTED", uncertain=("UNCERTAIN",), power_off="POWER_OFF", gas_detected="GAS",
    link_loss="LINK_LOSS", value_failure="VALUE_FAILURE", gas_type="MACHINERY", phase_type="FURNITURE",
    physical_ranges={t: (0.0, 200.0) for t in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")},
    gas_alarm=50.0, gas_explosive=100.0, data_end="2024-01-31 00:00:00", grid_from="2024-01-01",
    norm_days=7, outage_share=0.5, outage_hours=72, mass_channels=3, group_min_share=0.3, group_min_channels=3,
    group_daily_min_events=1, outage_day_min_s=3600,
    windows={"1h": 1, "6h": 6, "24h": 24, "7d": 48, "30d": 168, "90d": 336},
)
KIND_CODES = {"LINK_LOSS": "link", "FAULT": "fault", "DISCONNECTED": "disconnected", "VALUE_FAILURE": "value"}
SLICE_FROM, SLICE_TO = "2024-01-08", "2024-01-30"
_stages: dict[tuple, DataFrame] = {}


class Bed:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.spec = spark, str(sf_dir).rstrip("/"), SPEC
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the journal keeps one wall clock

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stage(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _stages:
            folder = self.dir.strip("/").replace("/", "_")
            _stages[key] = write_stage(build(), f"{folder}/{name}")
        return _stages[key]

    # ---- dimensions
    def channels(self) -> DataFrame:
        key, seg = F.col("c_custkey"), F.col("c_mktsegment")
        n = lambda m: F.pmod(key, F.lit(m)).cast("string")
        axis = F.concat(F.lit("ДД ПК"), n(500), F.lit("+"), n(10))
        gallery = F.concat(F.lit("КД ПК"), n(300), F.lit(" Г"), n(4), F.lit(" ПК"), n(40))
        return self.table("customer").select(
            key.alias("id"), F.col("c_nationkey").cast("long").alias("object_id"), seg.alias("sensor_type"),
            F.when(seg == "MACHINERY", "GAS_GUARD").when(seg == "BUILDING", "FIRE_GUARD")
            .when(seg == "AUTOMOBILE", "SECURITY").otherwise("OTHER").alias("system_type"),
            F.when(seg.isin("BUILDING", "HOUSEHOLD"), axis).when(seg == "MACHINERY", gallery)
            .otherwise(F.col("c_name")).alias("name"),
            F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), n(7), F.lit("."), n(100), F.lit("."),
                     key.cast("string"), F.lit(".")).alias("tag"),
        )

    def objects(self) -> DataFrame:
        root = self.table("region").select(
            F.lit(100000).cast("long").alias("id"), F.lit(1).alias("level"), F.lit(None).cast("long").alias("parent_id"),
            F.lit("ROOT").alias("name")).distinct()
        complexes = self.table("region").select(
            (F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(2).alias("level"),
            F.lit(100000).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
        subs = self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("id"), F.lit(3).alias("level"),
            (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
        return root.unionByName(complexes).unionByName(subs)

    # ---- journal
    def raw_journal(self) -> DataFrame:
        kind, v = F.col("event_type"), F.col("value")
        text = (
            F.when((kind == "error") & (v < 40), "FAULT").when((kind == "error") & (v < 100), "DISCONNECTED")
            .when(kind == "error", "01.01.1970 03:00:00").when((kind == "signup") & (v < 30), "POWER_OFF")
            .when((kind == "signup") & (v < 60), "UNCERTAIN").when((kind == "signup") & (v < 120), "OK")
            .when(kind == "signup", "GAS").otherwise(v.cast("string"))
        )
        return self.table("events").select(
            "event_id", F.col("user_id").alias("ch"), F.date_trunc("second", F.col("ts")).cast("timestamp").alias("ts"),
            F.when((kind == "error") | ((kind == "purchase") & (v >= 150)), "t").otherwise("f").alias("alarm_raw"),
            text.alias("raw"))

    def journal(self) -> DataFrame:
        """Clean typed journal, straight from the driver's events."""
        return classify_values(J.dedup_events(self.raw_journal()), self.channels(), self.spec)

    def events(self) -> DataFrame:
        """The clean journal as the written table every later step reads."""
        return self.stage("events", self.journal)

    def hourly(self) -> DataFrame:
        return self.stage("hourly", lambda: J.hourly_aggregates(self.events(), self.channels(), self.spec))

    def gaps(self) -> DataFrame:
        return self.stage("gaps", lambda: J.extract_gaps(self.events(), self.spec))

    def outages(self) -> DataFrame:
        return self.stage("outages", lambda: J.detect_outages(
            self.hourly(), self.spec.grid_from, self.spec.data_end, self.spec))

    def clock(self) -> DataFrame:
        return self.stage("clock", lambda: J.journal_clock(self.outages(), self.spec))

    def gaps_eff(self) -> DataFrame:
        return self.stage("gaps_eff", lambda: J.effective_gaps(self.gaps(), self.clock(), self.spec))

    def norm(self) -> DataFrame:
        return self.stage("norm", lambda: J.personal_norm(self.hourly(), self.gaps_eff(), self.spec))

    def link(self) -> DataFrame:
        return self.stage("link", lambda: J.link_losses(self.gaps_eff(), self.norm(), self.clock(), self.spec))

    def failures(self) -> DataFrame:
        return J.value_failures(self.events(), self.channels(), self.spec)

    def candidates(self) -> DataFrame:
        return self.stage("candidates", lambda: J.fault_candidates(self.events(), self.link(), self.failures(), self.spec))

    def faults(self) -> DataFrame:
        return self.stage("faults", lambda: J.finalise_faults(
            self.candidates(), self.link(), self.norm(), self.clock(), self.channels(), self.objects(), self.spec, keep=self.stage))

    # ---- predictions, decisions, orders
    def predictions(self) -> DataFrame:
        """A prediction per active channel every six hours: the probability is a fixed formula of recent counters."""
        return self.stage("predictions", self._predictions)

    def _predictions(self) -> DataFrame:
        spec = self.spec
        moments = X.slices(self.norm(), self.channels(), "hourly", SLICE_FROM, SLICE_TO).filter(F.hour("T") % 6 == 0)
        f_hours = X.fault_hours(self.faults(), spec)
        rec = X.recoveries(self.faults(), self.gaps_eff(), spec)
        c = X.channel_counters(moments, self.hourly(), f_hours, rec, spec)
        points = F.least(F.lit(9900), 200 + 2500 * F.least("fall_24h", F.lit(2)) + 900 * F.col("fall_7d") + 60 * F.col("ev_7d")
                         + 400 * F.col("fault_30d"))
        end = F.col("T") + F.expr("INTERVAL 24 HOURS")
        hit = F.coalesce(F.col("next_fault_ts") <= end, F.lit(False))
        closed = end <= F.lit(spec.data_end).cast("timestamp")
        kinds = {"link": "flnk_30d", "fault": "fflt_30d", "disconnected": "fdsc_30d", "value": "fvf_30d"}
        weight = F.col("flnk_30d") + F.col("fflt_30d") + F.col("fdsc_30d") + F.col("fvf_30d") + 4
        out = c.withColumn("prob", (points / 10000.0))
        out = out.withColumn("health", health(F.col("prob")))
        return out.select(
            (F.unix_timestamp("T") / 3600).cast("long").alias("_h"), F.col("ch").alias("channel_id"), F.col("T").alias("at"),
            F.lit(24).alias("horizon_h"), "prob", "health", risk_level(F.col("health")).alias("risk_level"),
            F.lit("v3").alias("model_version"), "fall_24h", "fall_7d", "ev_7d", "fault_30d", "chg_24h",
            *[((F.col(k) + 1) / weight).alias(f"p_{n}") for n, k in kinds.items()],
            F.when(closed, hit).alias("happened"), F.when(closed & hit, F.col("next_fault_ts")).alias("fault_at"),
            F.when(closed & hit, F.col("next_fault_kind")).alias("fault_kind"),
        ).withColumn("id", F.col("_h") * 1_000_000_000 + F.col("channel_id")).drop("_h")

    def scored(self) -> DataFrame:
        """Closed predictions as a scored table."""
        p = self.predictions().filter(F.col("happened").isNotNull())
        c = by_shuffle(self.channels().select(F.col("id").alias("channel_id"), "sensor_type", "system_type"))
        return p.join(c, "channel_id").select(
            F.col("at").alias("T"), F.col("channel_id").alias("ch"), F.col("prob").alias("p"), F.col("happened").cast("int").alias("y"),
            "fault_at", "fault_kind", "sensor_type", "system_type", F.col("fall_7d").alias("faults_7d"), "ev_7d", "chg_24h",
            "fault_30d", "fall_24h")

    def outcomes(self) -> DataFrame:
        p = self.predictions().filter(F.col("happened").isNotNull())
        return p.select(F.col("id").alias("prediction_id"), "happened", "fault_at", "fault_kind")

    def _orders(self) -> DataFrame:
        minutes = F.col("o_orderkey") * 7919 % 31680
        created = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-08").cast("timestamp")) + minutes * 60)
        o = self.table("orders").withColumn("created_at", created)
        slot = F.floor(F.unix_timestamp("created_at") / 21600) * 6
        return o.withColumn("pred", slot * 1_000_000_000 + F.col("o_custkey"))

    def decisions(self) -> DataFrame:
        s = F.col("o_orderstatus")
        d = self._orders().select(
            F.col("o_orderkey").alias("id"), F.col("pred").alias("prediction_id"),
            F.when(s == "F", "dispatch").when(s == "O", "monitor").otherwise("false_alarm").alias("decision_type"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("reason_id"), "created_at",
            F.concat(F.lit("="), F.col("o_orderpriority")).alias("comment"))
        return d.join(self.predictions().select(F.col("id").alias("prediction_id")), "prediction_id", "left_semi")

    def reasons(self) -> DataFrame:
        """Reasons by number: each fits one decision type, the last one is retired."""
        n = F.substring("o_orderpriority", 1, 1).cast("int")
        r = self.table("orders").select(n.alias("id"), F.col("o_orderpriority").alias("name")).distinct()
        return r.withColumns({
            "decision_type": F.when(F.col("id") <= 2, "dispatch").when(F.col("id") == 3, "monitor").otherwise("false_alarm"),
            "is_active": F.col("id") < 5})

    def work_orders(self) -> DataFrame:
        n = F.substring("o_orderpriority", 1, 1).cast("int")
        status = (F.when(n == 1, "done").when(n == 2, "in_progress").when(n == 3, "submitted").when(n == 4, "draft").otherwise("cancelled"))
        hours = F.floor("o_totalprice").cast("long") % 100 + 1
        closed = F.timestamp_seconds(F.unix_timestamp("created_at") + hours * 3600)
        s = F.col("o_orderstatus")
        w = self._orders().select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("WO-"), F.col("o_orderkey").cast("string")).alias("number"),
            F.col("o_custkey").alias("channel_id"), F.col("pred").alias("prediction_id"), status.alias("status"), "created_at",
            F.when(n.isin(1, 5), closed).alias("closed_at"),
            F.when(s == "F", "high").when(s == "O", "medium").otherwise("low").alias("priority"))
        return w.join(by_shuffle(self.channels().select(F.col("id").alias("channel_id"), "object_id")), "channel_id")

    def advised(self) -> DataFrame:
        """Predictions with factors and kind probabilities for the advice programs."""
        n = lambda c: F.col(c).cast("double")
        fac = lambda cond, name, value, norm: F.when(cond, F.struct(
            F.lit(name).alias("feature"), value.alias("value"), F.lit(norm).cast("double").alias("norm")))
        factors = F.array_compact(F.array(
            fac(F.col("ev_7d") <= 2, "hours_to_norm", n("ev_7d") + 1, 5.0), fac(F.col("fall_24h") > 0, "faults_24h", n("fall_24h"), 0.5),
            fac(F.col("chg_24h") >= 3, "status_changes_24h", n("chg_24h"), 1.0), fac(F.col("fault_30d") > 2, "fault_msgs_30d", n("fault_30d"), 1.0),
            fac(F.col("ev_7d") >= 8, "stuck_share_24h", n("ev_7d") / 10, 0.2), fac(F.col("fall_7d") >= 4, "nb_silent_share", n("fall_7d") / 8, 0.1),
            fac(F.col("ev_7d") <= 1, "gap_to_norm", n("ev_7d") + 2, 1.0)))
        kinds = F.map_from_arrays(F.array(*[F.lit(k) for k in ("link", "fault", "disconnected", "value")]),
                                  F.array(*[F.col(f"p_{k}") for k in ("link", "fault", "disconnected", "value")]))
        return self.predictions().withColumns({
            "top_factors": factors, "kind_probs": F.when(F.col("prob") >= 0.3, kinds)}).drop("happened", "fault_at", "fault_kind")
