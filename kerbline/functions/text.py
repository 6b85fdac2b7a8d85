"""Text cleaning, label checks, display formats and health bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .numeric import col

# Street class prefixes and abbreviations written out.
STREET_PREFIXES = ("ул.", "бул.", "жк", "кв.", "пл.")
STREET_ABBREVIATIONS = {
    "арх.": "архитект", "св.": "свети", "проф.": "професор", "ген.": "генерал", "инж.": "инженер", "д-р": "доктор",
}
# Parking zone wording and missing-value mark of the source files.
PUBLIC_ZONE = "Зона"
MISSING_MARK = "-"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_street(name) -> Column:
    """Comparable street name: no class word, abbreviations written out, single spaces."""
    low = F.trim(F.lower(F.coalesce(col(name).cast("string"), F.lit(""))))
    prefix = "^(?:" + "|".join(p.replace(".", r"\.") for p in STREET_PREFIXES) + r")\s*"
    bare = F.regexp_replace(low, prefix, "")
    return squeeze(reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), STREET_ABBREVIATIONS.items(), bare))


def street_match(a, b) -> Column:
    """Either normalised name holds the other; empty names never match."""
    x, y = norm_street(a), norm_street(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def blank_to_null(c) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.when((t != "") & (t != MISSING_MARK), t)


def tag_number(tag) -> Column:
    """A number out of a raw map tag: first of a list, comma decimals, metres or feet."""
    t = F.replace(F.lower(F.trim(F.get(F.split(col(tag), ";"), F.lit(0)))), F.lit(","), F.lit("."))
    feet = t.rlike(r"('|ft)$")
    bare = F.trim(F.regexp_replace(t, r"'*(ft)?m?$", ""))
    value = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), bare.try_cast("double"))
    return F.when(feet, value * 0.3048).otherwise(value)


# Storey height, default and largest storey counts.
FLOOR_M, DEFAULT_FLOORS, MAX_FLOORS = 3.0, 4, 40


def parse_height(levels, height) -> Column:
    """``struct<floors, floor_m>``: levels first, else the height split into storeys, else a default."""
    lv, h = tag_number(levels), tag_number(height)
    by_level = F.least(F.lit(MAX_FLOORS), F.bround(lv).cast("int"))
    by_height = F.greatest(F.lit(1), F.least(F.lit(MAX_FLOORS), F.bround(h / FLOOR_M).cast("int")))
    floors = F.when(lv >= 1, by_level).when(h > 0, by_height).otherwise(F.lit(DEFAULT_FLOORS))
    each = F.when(lv >= 1, F.lit(FLOOR_M)).when(h > 0, h / by_height).otherwise(F.lit(FLOOR_M))
    return F.struct(floors.alias("floors"), each.alias("floor_m"))


def road_width(lanes, highway) -> Column:
    """3.25 m a lane, at least 5 m; without a lane count 9 m for main roads, else 6.5 m."""
    n = F.when(F.trim(col(lanes)).rlike(r"^[+-]?\d+$"), F.trim(col(lanes)).try_cast("int"))
    main = col(highway).isin("primary", "secondary", "tertiary")
    return F.when(n.isNotNull(), F.greatest(F.lit(5.0), n * 3.25)).when(main, F.lit(9.0)).otherwise(F.lit(6.5))


def frame_no(filename) -> Column:
    """Trailing number of a frame file name, or -1."""
    stem = F.regexp_replace(F.element_at(F.split(col(filename), "/"), -1), r"\.[^.]*$", "")
    tail = F.element_at(F.split(stem, "_"), -1)
    return F.coalesce(F.when(tail.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(tail).try_cast("int")), F.lit(-1))


def valid_bbox(raw) -> Column:
    """``struct<x0,y0,x1,y1>`` of four comma-separated numbers; NULL when malformed."""
    parts = F.transform(F.split(col(raw), ","), lambda p: F.trim(p).try_cast("double"))
    ok = (F.size(parts) == 4) & F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(ok, F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))


def valid_lonlat(raw) -> Column:
    """``struct<lon,lat>`` within range, else NULL (NaN is out of range)."""
    parts = F.transform(F.split(col(raw), ","), lambda p: F.trim(p).try_cast("double"))
    lon, lat = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    ok = (F.size(parts) == 2) & ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) <= 180) & (F.abs(lat) <= 90)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(lon.alias("lon"), lat.alias("lat")))


# Plausible box sizes as a share of the picture, and how far a box may stick out.
BOX_MIN, BOX_MAX, BOX_SLACK = 0.01, 0.45, 0.01


def label_problems(line) -> Column:
    """Every problem of one label line as an array of short messages (empty when sound).

    The line is cut once and each number read once: what a rule repeats is computed again for every rule.
    """
    from .geo import let

    def read(f):
        cls = F.when(F.get(f, F.lit(0)).rlike(r"^[+-]?\d+$"), F.get(f, F.lit(0)).try_cast("int"))
        box = [F.get(f, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)]
        return F.struct((F.size(f) == 5).alias("five"), cls.alias("cls"), *box)

    def messages(v):
        five, cls, cx, cy, w, h = v.five, v.cls, v.cx, v.cy, v.w, v.h
        numeric = cls.isNotNull() & cx.isNotNull() & cy.isNotNull() & w.isNotNull() & h.isNotNull()
        ok = five & numeric

        def out_of_unit(x):
            return ok & ~x.between(0.0, 1.0)

        empty = ok & ((w <= 0) | (h <= 0))
        odd = ok & (w > 0) & (h > 0) & ~(w.between(BOX_MIN, BOX_MAX) & h.between(BOX_MIN, BOX_MAX))
        lo, hi = -BOX_SLACK, 1 + BOX_SLACK
        outside = ok & ((cx - w / 2 < lo) | (cx + w / 2 > hi) | (cy - h / 2 < lo) | (cy + h / 2 > hi))
        return F.array_compact(F.array(
            F.when(~five, "field count"), F.when(five & ~numeric, "not numeric"),
            F.when(ok & (cls != 0), "class"), F.when(out_of_unit(cx), "cx range"), F.when(out_of_unit(cy), "cy range"),
            F.when(out_of_unit(w), "w range"), F.when(out_of_unit(h), "h range"), F.when(empty, "zero area"),
            F.when(odd, "size"), F.when(outside, "outside image")))

    return let(let(F.split(F.trim(col(line)), r"\s+"), read), messages)


# ---- classification of picture statistics -----------------------------------

# Thresholds of the picture test.
CHROMA_MAX, DARK_MAX, PAINT_MAX, BRIGHT_LO, BRIGHT_HI, STD_MAX = 12.7, 0.02, 0.15, 82.0, 102.0, 50.0
# Reference brightness each frame statistic is scaled against.
FRAME_REFERENCE = {"f_mode": 121.0, "f_p60": 121.0, "f_median": 121.0, "f_bays": 84.7}
CORE_TESTS = ("chroma", "dark", "paint", "bright", "std")


def classify_core(chroma="core_chroma", dark="core_dark_frac", paint="core_paint_frac", brightness="core_brightness", std="core_std",
                  drop: tuple = (), scale_by: str | None = None) -> Column:
    """A bay core that differs from plain asphalt in any of five ways is occupied.

    ``drop`` leaves tests out and ``scale_by`` scales intensity thresholds by a frame statistic.
    """
    k = col(scale_by) / FRAME_REFERENCE[scale_by] if scale_by else F.lit(1.0)
    b = col(brightness)
    tests = {
        "chroma": col(chroma) > CHROMA_MAX * k,
        "dark": col(dark) > DARK_MAX,
        "paint": col(paint) > PAINT_MAX,
        "bright": ~((b > BRIGHT_LO * k) & (b < BRIGHT_HI * k)),
        "std": col(std) > STD_MAX * k,
    }
    kept = [t for n, t in tests.items() if n not in drop]
    return reduce(lambda p, q: p | q, kept, F.lit(False))


def is_oblique(brightness, blue_minus_red) -> Column:
    """A bright, bluish top strip is sky: the camera was not looking down."""
    return (col(brightness) > 180) & (col(blue_minus_red) > 10)


# ---- display -----------------------------------------------------------------

DASH = "—"


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("bigint")


def _s(c: Column) -> Column:
    return c.cast("string")


def format_distance(m) -> Column:
    m = col(m)
    return F.when(m < 950, F.concat(_s(_half_up(m / 10) * 10), F.lit(" m"))).otherwise(F.format_string("%.1f km", _half_up(m / 100) / 10))


def format_duration(s) -> Column:
    n = _half_up(col(s) / 60)
    long = F.concat(F.lit("~"), _s(F.floor(n / 60)), F.lit(" h "), _s(n % 60), F.lit(" min"))
    return F.when(n < 1, "< 1 min").when(n < 60, F.concat(F.lit("~"), _s(n), F.lit(" min"))).otherwise(long)


def age(s) -> Column:
    s = col(s)
    two = lambda c: F.lpad(_s(c), 2, "0")
    return (F.when(s.isNull(), DASH).when(s < 60, F.concat(_s(_half_up(s)), F.lit("s")))
            .when(s < 3600, F.concat(_s(F.floor(s / 60)), F.lit("m "), two(_half_up(F.pmod(s, F.lit(60.0)))), F.lit("s")))
            .otherwise(F.concat(_s(F.floor(s / 3600)), F.lit("h "), two(F.floor(F.pmod(s, F.lit(3600.0)) / 60)), F.lit("m"))))


def seconds(s) -> Column:
    c = col(s)
    return (F.when(c.isNull(), DASH).when(c < 1, F.concat(_s(_half_up(c * 1000)), F.lit(" ms")))
            .when(c < 60, F.format_string("%.1f s", c)).otherwise(age(s)))


def percent(fraction, digits: int = 1) -> Column:
    f = col(fraction)
    return F.when(f.isNull(), DASH).otherwise(F.format_string(f"%.{digits}f%%", f * 100))


# Health bands.
STALL_WARN_S, STALL_CRIT_S, DEPTH_WARN, MISSION_IDLE_S, LEASE_WARN = 60, 300, 50, 120, 5


def queue_tone(depth, oldest_s) -> Column:
    d, o = col(depth), col(oldest_s)
    return (F.when(o >= STALL_CRIT_S, "critical").when(o >= STALL_WARN_S, "warn").when(d >= DEPTH_WARN, "warn")
            .when(d > 0, "good").otherwise("idle"))


def lease_tone(expired) -> Column:
    return F.when(col(expired) >= LEASE_WARN, "warn").when(col(expired) > 0, "good").otherwise("idle")


def failure_tone(rate) -> Column:
    r = col(rate)
    return F.when(r.isNull(), "idle").when(r >= 0.1, "critical").when(r > 0, "warn").otherwise("good")


def accuracy_tone(acc) -> Column:
    a = col(acc)
    return F.when(a.isNull(), "idle").when(a < 0.9, "critical").when(a < 0.95, "warn").otherwise("good")


def mission_tone(since_s) -> Column:
    s = col(since_s)
    return F.when(s.isNull(), "idle").when(s >= MISSION_IDLE_S, "warn").otherwise("good")


# Kerb colours for unknown, none, few and plenty of free places.
KERB_COLOURS = ("#C6CED2", "#D7263D", "#F5A524", "#2E9E5B")


def kerb_colour(free, cars, capacity_observed) -> Column:
    f, c, cap = col(free), col(cars), col(capacity_observed)
    unknown = f.isNull() | c.isNull() | cap.isNull() | (cap == 0)
    return (F.when(unknown, KERB_COLOURS[0]).when(f == 0, KERB_COLOURS[1])
            .when(f / F.nullif(cap, F.lit(0)) < 0.25, KERB_COLOURS[2]).otherwise(KERB_COLOURS[3]))


def key_hash(secret) -> Column:
    return F.sha2(col(secret).cast("string"), 256)


def rebase_time(ts, first_ts, start) -> Column:
    """Shift a flight so that its first record falls on ``start``."""
    return col(start) + (col(ts) - col(first_ts))


# Beginnings of the source's words for how cars stand, and the kinds they name.
PARKING_KINDS = {"надлъж": "parallel", "напреч": "perpendicular", "кос": "angled"}


def parking_kind(value) -> Column:
    """``parallel``, ``perpendicular`` or ``angled`` for the source's wording; other words stay as they are."""
    word = col(value)
    out = word
    for start, kind in PARKING_KINDS.items():
        out = F.when(F.lower(F.trim(word)).startswith(start), F.lit(kind)).otherwise(out)
    return out
