"""How a site is reached: a decision over station, bus stop and walk that keeps unknown apart from bad."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Fixed values by default; minutes, trips a weekday, metres."""

    station_walk_max: int = 25
    bus_walk_max: int = 20
    min_trips: int = 6
    car_only_walk: int = 60
    moderate_walk: int = 15
    moderate_ascent: int = 30
    hard_walk: int = 30
    hard_ascent: int = 100


# Fixed values.
MODE_ORDER = {"TRAIN_ONLY": 0, "TRAIN_BUS": 1, "CAR_RECOMMENDED": 2, "UNKNOWN": 3, "CAR_ONLY": 4}
LOAD_ORDER = {"EASY": 0, "MODERATE": 1, "HARD": 2}
MODE_LABELS = {"TRAIN_ONLY": ("🚃", "電車のみ"), "TRAIN_BUS": ("🚌", "電車＋バス"), "CAR_RECOMMENDED": ("🚗", "車がおすすめ"), "CAR_ONLY": ("🚗", "車が必要"), "UNKNOWN": ("❓", "判定不能")}
NOT_SURVEYED = "アクセス未調査"
UNKNOWN_NOTE = "この地域はバスの運行データが公開されていないため、車が必要かどうかを判定できていません。バス停の位置は地図に表示しています。現地の時刻表をご確認ください。"
HARD_NOTE = "参道の登りがあります。歩きやすい靴をおすすめします。"
CAR_FREE_LABELS = {True: "車なしで行ける", False: "車が必要"}
NOT_SURVEYED_LABEL = "未調査"
HIGH_RELIEF = 30  # metres above what is around
LOAD_LABELS = {"EASY": "らく", "MODERATE": "ふつう", "HARD": "きつい"}


def rank(value: Column, order: dict[str, int]) -> Column:
    """Place in an order; 9 for null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), value), F.lit(9))


def label(value: Column, labels: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), value)


def walk_load(minutes: Column, ascent: Column, t: Thresholds = Thresholds()) -> Column:
    """The heavier of what the time and what the climb says; an unknown one says EASY."""
    step = lambda c, hard, moderate: F.when(c >= hard, 2).when(c >= moderate, 1).otherwise(0)
    return F.element_at(F.array(*map(F.lit, LOAD_ORDER)), F.greatest(step(minutes, t.hard_walk, t.moderate_walk), step(ascent, t.hard_ascent, t.moderate_ascent)) + 1)


def access_mode(station_walk: Column, bus: Column, bus_walk: Column, trips: Column, connects: Column, walk: Column, t: Thresholds = Thresholds()) -> Column:
    """TRAIN_ONLY, TRAIN_BUS, UNKNOWN (a bus stop whose trips aren't known), CAR_RECOMMENDED or CAR_ONLY. `bus` tells if there is a stop."""
    far = walk > t.car_only_walk
    return (
        F.when(station_walk <= t.station_walk_max, "TRAIN_ONLY")
        .when(bus & trips.isNull(), "UNKNOWN")
        .when(bus & (trips >= t.min_trips) & (bus_walk <= t.bus_walk_max) & F.coalesce(connects, F.lit(True)), "TRAIN_BUS")
        .when((bus | station_walk.isNotNull()) & far, "CAR_ONLY")
        .when(bus | station_walk.isNotNull(), "CAR_RECOMMENDED")
        .otherwise("CAR_ONLY")
    )


def reason(station: Column, bus: Column, walk: Column, t: Thresholds = Thresholds()) -> Column:
    """The sentence for each outcome, from structs station (name, walk_min) and bus (name, walk_min, trips_weekday, unknown_reason, connects_to_station)."""
    far = walk > t.car_only_walk
    say = lambda pattern, *args: F.format_string(pattern, *args)
    trips = bus["trips_weekday"]
    return (
        F.when(station["walk_min"] <= t.station_walk_max, say("%sから徒歩%d分。", station["name"], station["walk_min"]))
        .when(
            bus.isNotNull() & trips.isNull(),
            F.coalesce(
                bus["unknown_reason"],
                say("バス停「%s」はありますが、この地域のバス運行データが公開されていないため便数を確認できません。現地の時刻表をご確認ください。", bus["name"]),
            ),
        )
        .when(
            (trips >= t.min_trips) & (bus["walk_min"] <= t.bus_walk_max) & F.coalesce(bus["connects_to_station"], F.lit(True)),
            say("バス停「%s」（平日%d本/日）から徒歩%d分。", bus["name"], trips, bus["walk_min"]),
        )
        .when(bus.isNotNull() & far, say("最寄りの交通機関から徒歩%d分。公共交通では現実的ではありません。", walk))
        .when(bus.isNotNull() & (trips < t.min_trips), say("バス停「%s」の便数が平日%d本/日と少ないため、車をおすすめします。", bus["name"], trips))
        .when(bus.isNotNull(), say("バス停「%s」から徒歩%d分と離れています。", bus["name"], bus["walk_min"]))
        .when(station.isNotNull() & far, say("最寄り駅%sから徒歩%d分。公共交通では現実的ではありません。", station["name"], station["walk_min"]))
        .when(station.isNotNull(), say("最寄り駅%sから徒歩%d分。バス路線は確認できていません。", station["name"], station["walk_min"]))
        .otherwise("徒歩圏に鉄道駅・バス停が見つかりませんでした。")
    )


def assess(sites: DataFrame, t: Thresholds = Thresholds(), computed_at: str | None = None) -> DataFrame:
    """Adds access_mode, walk_load, reason and computed_at to rows with structs station and bus, walk_minutes and ascent_m."""
    s, b = F.col("station"), F.col("bus")
    mode = access_mode(s["walk_min"], b.isNotNull(), b["walk_min"], b["trips_weekday"], b["connects_to_station"], F.col("walk_minutes"), t)
    return sites.withColumns(
        {"access_mode": mode, "walk_load": walk_load(F.col("walk_minutes"), F.col("ascent_m"), t), "reason": reason(s, b, F.col("walk_minutes"), t), "computed_at": F.lit(computed_at)}
    )


def without_car(mode: Column, include_unknown: bool = False) -> Column:
    return mode.isin(*(["TRAIN_ONLY", "TRAIN_BUS"] + ["UNKNOWN"] * include_unknown))


def car_free_label(mode: Column) -> Column:
    """Whether a site is reached without a car, in words; a null mode is a site not looked at yet."""
    return F.when(mode.isNull(), F.lit(NOT_SURVEYED_LABEL)).when(without_car(mode), F.lit(CAR_FREE_LABELS[True])).otherwise(F.lit(CAR_FREE_LABELS[False]))


def badge(mode: Column, load: Column, minutes: Column, ascent: Column, around: Column) -> Column:
    """What a list shows of a site's access: icon, label, load, walk, and the notices that are due. A null mode is a site not looked at yet."""
    walk = F.concat_ws(" / ", F.when(minutes.isNotNull(), F.format_string("徒歩%d分", minutes)), F.when(ascent.isNotNull(), F.concat(F.lit("登り"), F.floor(ascent + 0.5).cast("string"), F.lit("m"))))
    notes = F.array_compact(
        F.array(
            F.when(mode == "UNKNOWN", F.lit(UNKNOWN_NOTE)),
            F.when(load == "HARD", F.lit(HARD_NOTE)),
            F.when(around >= HIGH_RELIEF, F.format_string("周辺より約%dm 高い場所にあります。", F.floor(around + 0.5))),
        )
    )
    return F.struct(
        F.coalesce(label(mode, {k: v[0] for k, v in MODE_LABELS.items()}), F.lit("❓")).alias("icon"),
        F.coalesce(label(mode, {k: v[1] for k, v in MODE_LABELS.items()}), F.lit(NOT_SURVEYED)).alias("label"),
        F.concat(F.lit("徒歩"), label(load, LOAD_LABELS)).alias("load"),
        walk.alias("walk"),
        notes.alias("notes"),
    )
