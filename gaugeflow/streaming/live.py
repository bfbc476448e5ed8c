"""Live nowcasts: records in, rolling state, forecasts out.

The stream keeps no operator state of its own. Every micro-batch merges its records into a rolling
state table and runs the batch operators on the recent slice, so live and batch results agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..clock import Clock
from ..functions.link import scenario_array, scenario_attenuation
from ..functions.names import normalize_station_id
from ..functions.rain import not_nan
from ..operators.channels import OWN, station_channels
from ..operators.features import build_features
from ..operators.halo import Slices
from ..operators.neighbours import neighbour_aggregates, neighbour_trend
from ..operators.quality import MET, dedup_first_nonnull, range_clean
from ..params import ChannelParams, FeatureParams, LinkParams, TruthParams

FIELDS = ("precip_past1min", "precip_past10min", *MET)
STATE_COLUMNS = ("station_id", "minute", *FIELDS)
RECORD_SCHEMA = "station_id string, time timestamp, " + ", ".join(f"{c} double" for c in FIELDS)
HISTORY, SLACK, STALE = 240, 30, 10  # fixed values: ticks of history, extra kept, age that raises a warning


def ingest_records(records: DataFrame, stations: DataFrame, clock: Clock = Clock(), seq: str = "seq", clean: bool = True,
                   p: TruthParams = TruthParams()) -> DataFrame:
    """Records on ticks (floored), known stations only, last non-null value per field."""
    minute = F.col("minute") if "minute" in records.columns else clock.index(F.col("time"))
    fields = [(not_nan(F.col(c)) if c in records.columns else F.lit(None).cast("double")).alias(c) for c in FIELDS]
    rows = records.select(normalize_station_id(F.col("station_id")).alias("station_id"), minute.cast("long").alias("minute"), F.col(seq).alias("seq"), *fields)
    rows = rows.join(stations.select("station_id"), "station_id", "left_semi")
    return dedup_first_nonnull(range_clean(rows, p) if clean else rows, last=True).select(*STATE_COLUMNS)


def upsert(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """New values replace old ones field by field; sending a record again changes nothing."""
    if state is None:
        return batch
    both = state.withColumn("seq", F.lit(0)).unionByName(batch.withColumn("seq", F.lit(1)))
    return dedup_first_nonnull(both, last=True).select(*STATE_COLUMNS)


def late_data_cutoff(state: DataFrame, keep: int = HISTORY + SLACK) -> DataFrame:
    """Per station only ticks within ``keep`` of its own newest one. Spark's watermark is one clock for all stations."""
    newest = state.groupBy("station_id").agg((F.max("minute") - keep).alias("from_"))
    return state.join(newest, "station_id").where(F.col("minute") >= F.col("from_")).drop("from_")


def staleness_flag(state: DataFrame, now: DataFrame) -> DataFrame:
    """Ticks since a station's last own one-minute value at ``now`` (a single row) and the warning."""
    last = state.withColumn("now", now.scalar()).where("minute <= now")
    age = last.groupBy("station_id").agg((F.max("now") - F.max(F.when(F.col("precip_past1min").isNotNull(), F.col("minute")))).alias("input_age_min"))
    return age.withColumn("warning", F.col("input_age_min").isNull() | (F.col("input_age_min") > STALE))


def latest_tick(state: DataFrame) -> DataFrame:
    return state.agg(F.max("minute").alias("now"))


def history_slice(state: DataFrame, now: DataFrame, history: int = HISTORY) -> DataFrame:
    """Dense last ``history`` ticks of every station in the state."""
    ids = state.select("station_id").distinct().withColumn("now", now.scalar())
    grid = ids.select("station_id", F.explode(F.sequence(F.col("now") - (history - 1), F.col("now"))).alias("minute"))
    obs = grid.join(state, ["station_id", "minute"], "left")
    return obs.select("station_id", "minute", F.col("precip_past1min").alias("p1_obs"), F.col("precip_past10min").alias("p10_obs"), *MET)


def rolling_history_forecast(state: DataFrame, stations: DataFrame, profile: DataFrame, predict: Callable[[DataFrame], DataFrame],
                             now: DataFrame | None = None, clock: Clock = Clock(), history: int = HISTORY, link: LinkParams = LinkParams(),
                             channel: ChannelParams = ChannelParams(), feature: FeatureParams = FeatureParams(),
                             slices: Slices = Slices()) -> DataFrame:
    """Forecast of the tick after ``now`` for every station in the state, with link attenuation and input age."""
    now = latest_tick(state) if now is None else now
    obs = history_slice(state, now, history)
    own = station_channels(obs, stations, clock, channel, slices)
    chans = neighbour_trend(neighbour_aggregates(own, profile, channel, list(OWN)), slices)
    rows = build_features(chans, feature, slices).where(F.col("minute") == now.scalar())
    rows = rows.withColumns({"month": clock.month(F.col("minute")), "hour": clock.hour(F.col("minute"))})
    out = predict(rows).select("station_id", F.col("minute").alias("issue_minute"), (F.col("minute") + 1).alias("valid_minute"), "p_rain",
                               F.col("y_hat").alias("rain_mm_next_minute"), (F.col("y_hat") * 60).alias("rain_rate_mmh"), F.col("q90").alias("rain_mm_q90"))
    out = out.join(stations.select("station_id", "lat"), "station_id", "left").join(staleness_flag(state, now), "station_id", "left")
    s = scenario_array(link.scenarios)
    db = F.map_from_entries(F.transform(s, lambda x: F.struct(x["scenario"], scenario_attenuation(
        F.col("rain_mm_next_minute"), x, F.coalesce("lat", F.lit(link.default_lat)), link.rain_height_km))))
    return out.withColumn("attenuation_db", db).drop("lat")


def replay_scoring(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """Forecasts next to the validated rain of their tick: counts and mean absolute error."""
    obs = truth.where("valid > 0").select("station_id", F.col("minute").alias("valid_minute"), F.col("precip").alias("observed"))
    j = forecasts.join(obs, ["station_id", "valid_minute"], "left")
    return j.agg(F.count(F.lit(1)).alias("forecasts"), F.count("observed").alias("scored"),
                 F.avg(F.abs(F.col("rain_mm_next_minute") - F.col("observed"))).alias("mae_mm"))


def score_stream(forecasts: DataFrame, truth: DataFrame, delay: str = "270 minutes") -> DataFrame:
    """Each streamed forecast once, next to the validated rain of its tick: the streaming form of ``replay_scoring``.

    ``forecasts`` has station_id, valid_time and rain_mm_next_minute, ``truth`` station_id, time, valid and precip.
    Both sides keep at most ``delay`` of event time; the first of several rows for a station and tick counts. A
    forecast whose tick gets no valid rain comes out with null once the watermark has passed it. Null stations
    or times meet nothing.
    """
    issued = (forecasts.select("station_id", "valid_time", "rain_mm_next_minute").withWatermark("valid_time", delay)
              .dropDuplicatesWithinWatermark(["station_id", "valid_time"]))
    seen = (truth.where("valid > 0").select(F.col("station_id").alias("at_station"), F.col("time").alias("at_time"), F.col("precip").alias("observed"))
            .withWatermark("at_time", delay).dropDuplicatesWithinWatermark(["at_station", "at_time"]))
    j = issued.join(seen, (F.col("station_id") == F.col("at_station")) & (F.col("valid_time") == F.col("at_time")), "left")
    return j.select("station_id", "valid_time", "rain_mm_next_minute", "observed", F.abs(F.col("rain_mm_next_minute") - F.col("observed")).alias("error_mm"))


def drop_resent(stream: DataFrame, delay: str = "270 minutes") -> DataFrame:
    """Drop records sent again unchanged; only for feeds that never correct a value (else rely on the upsert)."""
    return stream.withWatermark("time", delay).dropDuplicatesWithinWatermark(["station_id", "time"])


class LiveNowcast:
    """Structured Streaming service: records -> state table -> forecast table.

    Every epoch writes the state to a folder of its own and starts from the last whole one before it, whichever epoch that
    was. An epoch replayed after a failure overwrites its folder, so no record counts twice. A progress folder belongs to a
    run; a new one over the same root starts a new run, whose epochs count from 0 again but follow the state of the runs
    before. Two folders are kept.
    """

    def __init__(self, spark: SparkSession, root: str, stations: DataFrame, profile: DataFrame, predict: Callable[[DataFrame], DataFrame],
                 clock: Clock = Clock(), history: int = HISTORY, slices: Slices = Slices(), progress: str = "progress"):
        self.spark, self.root, self.progress = spark, root.rstrip("/"), progress
        self.stations, self.profile, self.predict, self.clock = stations, profile, predict, clock
        self.history, self.slices = history, slices
        self.schema = "station_id string, minute long, " + ", ".join(f"{c} double" for c in FIELDS)
        self.run: int | None = None

    def _path(self, name: str):
        """The path of a folder below the root and its file system, as Hadoop knows them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _stored(self) -> list[tuple[int, int]]:
        """(run, epoch) of the whole states, in order."""
        keys = [tuple(map(int, n.removeprefix("run-").split("-epoch-"))) for n in self._names("state") if n.startswith("run-")]
        return sorted(k for k in keys if "_SUCCESS" in self._names(self._name(*k)))

    @staticmethod
    def _name(run: int, epoch: int) -> str:
        return f"state/run-{run}-epoch-{epoch}"

    def _enter_run(self) -> int:
        """The run of the progress folder; a folder without one gets the next."""
        marks = [int(n.removeprefix("run-")) for n in self._names(self.progress) if n.startswith("run-")]
        if not marks:
            marks = [max([r for r, _ in self._stored()], default=-1) + 1]
            path, fs = self._path(f"{self.progress}/run-{marks[0]}")
            fs.mkdirs(path)
        self.run = max(marks)
        return self.run

    def state_path(self, epoch: int) -> str:
        return f"{self.root}/{self._name(self._enter_run() if self.run is None else self.run, epoch)}"

    def state(self, epoch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.state_path(epoch))

    def before(self, epoch: int) -> DataFrame | None:
        """The last whole state before this epoch of this run, None if there is none."""
        run = self._enter_run() if self.run is None else self.run
        earlier = [k for k in self._stored() if k < (run, epoch)]
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{self._name(*earlier[-1])}") if earlier else None

    def forecasts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/forecasts")

    def handle(self, batch: DataFrame, epoch: int) -> None:
        rows = batch if "seq" in batch.columns else batch.withColumn("seq", F.monotonically_increasing_id())
        new = ingest_records(rows, self.stations, self.clock)
        state = late_data_cutoff(upsert(self.before(epoch), new), self.history + SLACK)
        state.write.mode("overwrite").parquet(self.state_path(epoch))
        out = rolling_history_forecast(self.state(epoch), self.stations, self.profile, self.predict, None, self.clock, self.history, slices=self.slices)
        out = out.withColumns({"run": F.lit(self.run), "epoch": F.lit(epoch)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "epoch").parquet(f"{self.root}/forecasts")
        for old in [k for k in self._stored() if k < (self.run, epoch)][:-1]:
            path, fs = self._path(self._name(*old))
            fs.delete(path, True)

    def start(self, records: DataFrame, available_now: bool = False, interval: str = "1 minute") -> StreamingQuery:
        self._enter_run()
        writer = records.writeStream.foreachBatch(self.handle).option("checkpointLocation", f"{self.root}/{self.progress}")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


