"""Source adapters: each maps its records to one canonical incident layout, in a single projection.

Canonical columns: report_id, source, incident_date, country, site, sector, activity, description, hazard,
barrier_failure, consequence, fatalities, injuries, injury_severity, sif_potential, data_type. Missing values
stay missing; nothing is invented beyond the documented fallbacks. ``full`` adds lsr (life-saving rule by keywords of
the source), energy and metadata (JSON of fields without a column), and has CER and OISD tell short narratives from
the other fields; OSHA is always full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.functions.text import MISSING, clean_text

MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
OIL_GAS_NAICS = ("211", "213", "324", "486")  # fixed values
#: Words that mark an employer or narrative as oil and gas.
OIL_GAS_WORDS = ("DRILLING", "WELLHEAD", "RIG", "RIG FLOOR", "REFINERY", "PIPELINE", "OILFIELD", "HYDRAULIC FRACTURING", "FRACKING", "FRAC TANK", "BLOWOUT", "CRUDE OIL", "PETROLEUM")
YES = ("yes", "true", "1", "high", "y")


def text(c: str) -> Column:
    """Cleaned, '' where null."""
    return F.coalesce(clean_text(F.col(c).cast("string")), F.lit(""))


def opt(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin(*MISSING), None).otherwise(F.trim(c))


def whole(c: str) -> Column:
    """Whole number cut off from a number in text; null where there is none."""
    return F.expr(f"try_cast(try_cast(trim(cast(`{c}` as string)) as double) as int)")


def iso_date(c: Column) -> Column:
    """The calendar date of the usual notations, month first where a numeric date allows both; null where unreadable."""
    v = F.trim(c)
    date = lambda pattern, y, m, d: F.when(v.rlike(pattern), F.try_to_date(F.concat_ws("-", *(F.regexp_extract(v, pattern, k) if isinstance(k, int) else k for k in (y, m, d))), "yyyy-M-d"))
    month = lambda pattern, k: F.when(F.length(F.regexp_extract(v, pattern, k)) == 3, F.floor((F.position(F.upper(F.regexp_extract(v, pattern, k)), F.lit(MONTHS)) + 2) / 3).cast("string"))
    iso, us, slash, dash = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ].*)?$", r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: .*)?$", r"^(\d{4})/(\d{2})/(\d{2})$", r"^(\d{2})-(\d{2})-(\d{4})$"
    named, short, long = r"^(\d{2})-([A-Za-z]{3})-(\d{4})$", r"^(\d{2})-([A-Za-z]{3})-(\d{2})$", r"^([A-Za-z]{3}) (\d{1,2}), (\d{4})$"
    return F.date_format(F.coalesce(date(iso, 1, 2, 3), date(us, 3, 1, 2), date(us, 3, 2, 1), date(slash, 1, 2, 3), date(dash, 3, 2, 1), date(named, 3, month(named, 2), 1), date(short, F.concat(F.lit("20"), F.regexp_extract(v, short, 3)), month(short, 2), 1), date(long, 3, month(long, 1), 2)), "yyyy-MM-dd")


def _severity(deaths: Column, injuries: Column) -> Column:
    return F.when(deaths > 0, "FATALITY").when(injuries > 0, "HOSPITALIZED")


def _first(words: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The rule of the first list of keywords (with bars between) of which one is contained."""
    found = F
    for keys, rule in rules:
        found = found.when(reduce(lambda a, b: a | b, (words.contains(k) for k in keys.split("|"))), rule)
    return found if otherwise is None else found.otherwise(otherwise)


def _upper(*parts: Column) -> Column:
    return F.upper(F.concat_ws(" ", *parts))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"}).alias("metadata")


def _told(c: str, *parts: Column) -> Column:
    """The text, or the sentences of the other fields where it is shorter than 10."""
    return F.when(F.length(text(c)) >= 10, text(c)).otherwise(F.concat_ws(" ", *parts))


def _say(before: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(before), c, F.lit(".")))


def phmsa(df: DataFrame, full: bool = False) -> DataFrame:
    deaths, hurt = whole("num_fatalities"), whole("num_injuries")
    flag = lambda c: F.upper(text(c)).isin("YES", "Y", "1", "TRUE")
    ignite, explode = flag("ignite_ind"), flag("explode_ind")
    both = F.upper(F.concat(text("commodity_released_type"), text("system_type")))
    commodity = text("commodity_released_type")
    sector = F.when(both.contains("GAS"), "Pipeline Transportation - Natural Gas").when(both.contains("LIQUID") | F.upper(commodity).contains("CRUDE"), "Pipeline Transportation - Hazardous Liquids").when(commodity != "", F.concat(F.lit("Pipeline Transportation - "), commodity)).otherwise("Pipeline Transportation")
    place = F.array_join(F.filter(F.array(text("location_city_name"), text("location_state_abbreviation")), lambda x: x != ""), ", ")
    site = F.trim(F.concat(text("operator_name"), F.when(place != "", F.concat(F.lit(" ("), place, F.lit(")"))).otherwise("")))
    made = F.concat_ws(" ", F.concat(F.lit("PHMSA reported pipeline accident involving "), F.when(text("operator_name") != "", text("operator_name")).otherwise("operator"), F.lit(".")), F.when(text("system_part_involved") != "", F.concat(F.lit("Component involved: "), text("system_part_involved"), F.lit("."))), F.when(text("cause") != "", F.concat(F.lit("Cause documented: "), text("cause"), F.lit("."))))
    told = F.when(F.length(text("narrative")) >= 10, text("narrative")).otherwise(made)
    words = _upper(text("cause"), text("subcause"), told)
    lsr = F.coalesce(_first(words, [("CORROSION|MATERIAL FAILURE", "Asset Integrity / Work Authorisation"), ("EXCAVATION|THIRD PARTY|DIGGING", "Excavation / Line of Fire"), ("ISOLATION|VALVE", "Energy Isolation")]), F.when(ignite | explode | words.contains("HOT WORK"), "Hot Work"))
    more = (lsr.alias("lsr"), F.lit("Pressure & Chemical Hydrocarbon").alias("energy"), _json(system_part=F.col("system_part_involved"), release_volume=F.col("unintentional_release_bbls").cast("string"), commodity_type=commodity, fire_ignition=ignite, explosion=explode)) if full else ()
    return df.filter("report_number is not null and trim(report_number) != ''").select(
        F.concat(F.lit("PHMSA-"), F.trim("report_number")).alias("report_id"), F.lit("PHMSA").alias("source"), iso_date(F.col("local_datetime")).alias("incident_date"), F.lit("USA").alias("country"), F.when(site != "", site).alias("site"), sector.alias("sector"),
        F.lit("Pipeline Transmission & Distribution").alias("activity"), told.alias("description"), F.coalesce(opt(commodity), F.lit("Pressurized Hydrocarbon")).alias("hazard"),
        opt(F.array_join(F.filter(F.array(text("cause"), text("subcause")), lambda x: x != ""), " - ")).alias("barrier_failure"), F.concat(F.when(explode, "Explosion, ").otherwise(""), F.when(ignite, "Fire, ").otherwise(""), F.lit("Loss of Containment")).alias("consequence"),
        deaths.alias("fatalities"), hurt.alias("injuries"), _severity(deaths, hurt).alias("injury_severity"), F.when((deaths > 0) | (hurt > 0) | explode, True).when((deaths == 0) & (hurt == 0) & ~ignite & ~explode, False).alias("sif_potential"), F.lit("real").alias("data_type"), *more,
    ).distinct()


def cer(df: DataFrame, full: bool = False) -> DataFrame:
    deaths, hurt = whole("fatalities"), whole("serious_injuries")
    significant = F.lower(text("significant")).isin("yes", "true", "1")
    site = F.array_join(F.filter(F.array(text("company"), text("pipeline_name"), text("province")), lambda x: x != ""), " - ")
    told = _told("what_happened", F.concat(F.lit("CER recorded pipeline incident involving "), F.when(text("company") != "", text("company")).otherwise("operator"), F.lit(" on "), F.when(text("pipeline_name") != "", text("pipeline_name")).otherwise("pipeline"), F.lit(".")), _say("Primary cause: ", text("primary_cause")), _say("Substance involved: ", text("substance")), _say("Effects observed: ", text("adverse_effects")))
    lsr = _first(_upper(text("primary_cause"), told), [("CORROSION|CRACKING|DEFECT", "Asset Integrity / Work Authorisation"), ("EXTERNAL INTERFERENCE|EXCAVATION", "Excavation / Line of Fire"), ("INCORRECT OPERATION|VALVE|ISOLATION", "Energy Isolation"), ("FIRE|EXPLOSION", "Hot Work")])
    more = (lsr.alias("lsr"), F.lit("Pressure & Stored Chemical Energy").alias("energy"), _json(pipeline_name=text("pipeline_name"), province=text("province"), substance=text("substance"), significant_flag=significant, approximate_volume_released=F.col("approximate_volume_released"))) if full else ()
    return df.filter("incident_number is not null and trim(incident_number) != ''").select(
        F.concat(F.lit("CER-"), F.trim("incident_number")).alias("report_id"), F.lit("CER").alias("source"), iso_date(F.col("incident_date")).alias("incident_date"), F.lit("Canada").alias("country"), F.when(site != "", site).alias("site"),
        F.when(text("substance") != "", F.concat(F.lit("Pipeline Transportation - "), text("substance"))).otherwise("Pipeline Transportation").alias("sector"), F.coalesce(opt(text("activity_at_time")), F.lit("Pipeline Operations & Maintenance")).alias("activity"), (told if full else text("what_happened")).alias("description"),
        F.coalesce(opt(text("substance")), F.lit("Pressurized Pipeline Fluid")).alias("hazard"), opt(text("primary_cause")).alias("barrier_failure"), F.when(text("adverse_effects") != "", text("adverse_effects")).otherwise("Loss of Containment").alias("consequence"),
        deaths.alias("fatalities"), hurt.alias("injuries"), _severity(deaths, hurt).alias("injury_severity"), F.when((deaths > 0) | (hurt > 0) | significant, True).when((deaths == 0) & (hurt == 0), False).alias("sif_potential"), F.lit("real").alias("data_type"), *more,
    ).distinct()


def oisd(df: DataFrame, full: bool = False) -> DataFrame:
    deaths, hurt = whole("fatalities"), whole("injuries")
    site = F.array_join(F.filter(F.array(text("installation_unit"), text("organization"), text("state_region")), lambda x: x != ""), " - ")
    words = F.upper(F.concat_ws(" ", text("organization"), text("installation_unit")))
    guess = F.when(words.contains("REFINERY") | words.contains("CDU") | words.contains("PETROCHEM"), "Downstream - Refining & Petrochemicals").when(words.contains("PIPELINE") | words.contains("PUMPING"), "Midstream - Cross-Country Pipelines").otherwise("Upstream - Exploration & Production")
    flag = F.lower(F.trim("sif_potential"))
    where = F.coalesce(*(F.when(text(c) != "", text(c)) for c in ("installation_unit", "organization")), F.lit("oil & gas installation"))
    told = _told("description_of_incident", F.concat(F.lit("OISD safety case record at "), where, F.lit(".")), _say("Activity underway: ", opt(text("activity_underway"))), _say("Hazard encountered: ", text("hazard_type")), _say("Barrier deficiency: ", text("barrier_failure")))
    rule = F.coalesce(*(F.when(text(c) != "", text(c)) for c in ("life_saving_rule_violated", "oisd_standard")), F.lit(""))
    lsr = _first(_upper(rule, told, opt(text("barrier_failure"))), [("ISOLATION|LOTO|ENERGY", "Energy Isolation"), ("HOT WORK|PERMIT|PTW|OISD-STD-105", "Hot Work / Work Authorisation"), ("LINE OF FIRE|HOSE|PRESSURE", "Line of Fire"), ("CONFINED SPACE|CSE", "Confined Space Entry"), ("LIFTING|CRANE|SUSPENDED", "Mechanical Lifting"), ("BYPASS|INTERLOCK", "Bypassing Safety Controls")], F.when(rule != "", rule))
    energy = F.coalesce(opt(text("energy_source")), F.lit("Hydrocarbon Chemical & Pressure Energy"))
    more = (lsr.alias("lsr"), energy.alias("energy"), _json(organization=text("organization"), unit=text("installation_unit"), oisd_standard=F.col("oisd_standard"))) if full else ()
    return df.filter("incident_no is not null and trim(incident_no) != ''").select(
        F.concat(F.lit("OISD-"), F.trim("incident_no")).alias("report_id"), F.lit("OISD").alias("source"), iso_date(F.col("date_of_occurrence")).alias("incident_date"), F.lit("India").alias("country"), F.when(site != "", site).alias("site"),
        F.when(text("sector") != "", text("sector")).otherwise(guess).alias("sector"), opt(text("activity_underway")).alias("activity"), (told if full else text("description_of_incident")).alias("description"), F.coalesce(opt(text("hazard_type")), F.lit("Pressurized Hydrocarbon")).alias("hazard"),
        opt(text("barrier_failure")).alias("barrier_failure"), F.when(text("consequence") != "", text("consequence")).otherwise("Loss of Containment / Flash Fire").alias("consequence"), deaths.alias("fatalities"), hurt.alias("injuries"), _severity(deaths, hurt).alias("injury_severity"),
        F.when(flag.isNotNull(), flag.isin("yes", "true", "1", "high")).when((deaths > 0) | (hurt > 0), True).when((deaths == 0) & (hurt == 0), False).alias("sif_potential"), F.lit("real").alias("data_type"), *more,
    ).distinct()


def is_oil_gas(naics: Column, employer: Column, narrative: Column) -> Column:
    code, words = F.coalesce(F.trim(naics), F.lit("")), F.upper(F.concat_ws(" ", employer, narrative))
    by_code = code.startswith(OIL_GAS_NAICS[0])
    for p in OIL_GAS_NAICS[1:]:
        by_code = by_code | code.startswith(p)
    return by_code | words.rlike(r"\b(" + "|".join(OIL_GAS_WORDS) + r")\b")


def osha(rows: DataFrame, only_oil_gas: bool = True) -> DataFrame:
    """From sound raw records (``fields`` maps)."""
    names = {"id": "ID", "day": "Incident Date", "employer": "Employer", "city": "City", "state": "State", "naics": "NAICS", "event": "EventTitle", "thing": "SourceTitle", "nature": "NatureTitle", "part": "PartTitle", "fatality": "Fatality", "hospitalized": "Hospitalized", "amputation": "Amputation", "narrative": "Final Narrative"}
    df = rows.select(*((F.trim(c) if k == "id" else c).alias(k) for k, c in ((k, F.col("fields").getItem(v)) for k, v in names.items()))).filter("id is not null and id != ''")
    ours, code = is_oil_gas(F.col("naics"), F.col("employer"), F.col("narrative")), F.coalesce(F.trim("naics"), F.lit(""))
    if only_oil_gas:
        df = df.filter(ours)  # out of domain is skipped, not rejected
    dead, hosp, lost = whole("fatality"), whole("hospitalized"), whole("amputation")
    event, thing, nature, part = text("event"), text("thing"), text("nature"), text("part")
    sector = F.when(code.startswith("211"), "Upstream - Oil and Gas Extraction").when(code.startswith("213"), "Upstream - Drilling and Well Services").when(code.startswith("324"), "Downstream - Petroleum Refining").when(code.startswith("486"), "Midstream - Pipeline Transportation").when(ours, "Oil and Gas Operations").otherwise("Industrial Workplace")
    site = F.array_join(F.filter(F.array(text("employer"), text("city"), text("state")), lambda x: x != ""), " - ")
    activity = opt(F.array_join(F.filter(F.array(event, thing), lambda x: x != ""), " involving "))
    told = _told("narrative", F.concat(F.lit("OSHA severe injury reported at "), F.when(text("employer") != "", text("employer")).otherwise("worksite"), F.lit(".")), _say("Event: ", activity), _say("Injury sustained: ", F.when((nature != "") & (part != ""), F.concat(nature, F.lit(" to "), part)).otherwise(nature)))
    energy = _first(F.upper(told), [("PRESSURE|HYDRAULIC", "Hydraulic & Pressure Energy"), ("ELECTRICAL|VOLTAGE", "Electrical Energy"), ("THERMAL|BURN|FIRE", "Thermal & Flammable Hydrocarbon")], F.lit("Mechanical & Kinetic Energy"))
    lsr = _first(_upper(event, thing, told), [("LINE OF FIRE|PINCH|STRUCK|CAUGHT", "Line of Fire"), ("FALL|HEIGHT|SCAFFOLD|LADDER", "Working at Height"), ("CRANE|HOIST|SLING|SUSPENDED", "Mechanical Lifting"), ("ISOLATION|LOTO|ENERGIZED", "Energy Isolation"), ("CONFINED", "Confined Space Entry"), ("HOT WORK|WELDING|TORCH", "Hot Work")])
    none = lambda c: F.coalesce(c == 0, F.lit(True))
    return df.select(
        F.concat(F.lit("OSHA-"), "id").alias("report_id"), F.lit("OSHA").alias("source"), iso_date(F.col("day")).alias("incident_date"), F.lit("USA").alias("country"), F.when(site != "", site).alias("site"), sector.alias("sector"), activity.alias("activity"), told.alias("description"),
        F.coalesce(opt(thing), F.lit("Mechanical / Industrial Equipment")).alias("hazard"), F.when(event != "", F.concat(F.lit("Deficiency in barrier during "), event)).alias("barrier_failure"), F.when(nature != "", nature).otherwise("Severe Occupational Injury").alias("consequence"), dead.alias("fatalities"), hosp.alias("injuries"),
        F.when(dead > 0, "FATALITY").when(hosp > 0, "HOSPITALIZED").when(lost > 0, "AMPUTATION").alias("injury_severity"), F.when((dead > 0) | (hosp > 0) | (lost > 0), True).when((dead == 0) & none(hosp) & none(lost), False).alias("sif_potential"), F.lit("real").alias("data_type"),
        lsr.alias("lsr"), energy.alias("energy"), _json(employer=text("employer"), naics=code, nature=nature, part_of_body=F.col("part"), event_title=event, source_title=thing, hospitalized=hosp, amputation=lost),
    ).distinct()


ADAPTERS = {"phmsa": phmsa, "cer": cer, "oisd": oisd}


def quality(incidents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Completeness and repeats of canonical incidents in one aggregate, and a score of 100: 40 text, 20 date, 20 context, 20 less repeats."""
    n = F.count("*")
    short = F.count_if(F.coalesce(F.length("description"), F.lit(0)) < 10)
    context = F.avg((F.col("site").isNotNull().cast("int") + F.col("sector").isNotNull().cast("int") + F.col("activity").isNotNull().cast("int")) / 3.0)
    q = incidents.groupBy(*(keys or [])).agg(n.alias("n"), short.alias("missing_text"), F.count_if(F.col("incident_date").isNull()).alias("missing_date"), (n - F.countDistinct("report_id")).alias("repeats"), F.round(context, 4).alias("context_share"), F.count("sif_potential").alias("labelled"))
    score = 40 * (1 - F.col("missing_text") / F.col("n")) + 20 * (1 - F.col("missing_date") / F.col("n")) + 20 * F.col("context_share") + 20 - 10 * F.col("repeats") / F.col("n")
    return q.withColumn("score", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 1))
