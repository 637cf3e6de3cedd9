"""Patterns and numbers that results depend on, as the application's contract states them.

Patterns are matched without case. Nothing here is logic; the rule catalogue, which is configuration, is a parameter
of the operators that use it.
"""

from __future__ import annotations

# Energy of a narrative, exposure to it, and failed barriers.
ENERGY_PATTERNS = {
    "electrical": [r"\blive electrical\b", r"\barc flash\b", r"\bhigh voltage\b", r"\benergized\b"],
    "pressure": [r"\bpressure\b", r"\bpressurised\b", r"\bpressurized\b", r"\bwellhead\b", r"\bWHP\b"],
    "gravity": [r"\bdropped object\b", r"\bfall from\b", r"\bsuspended load\b", r"\bworking at height\b"],
    "mechanical": [r"\bcrane\b", r"\brigging\b", r"\brotating equipment\b", r"\bpinch point\b"],
    "chemical": [r"\bhydrogen sulfide\b", r"\bH2S\b", r"\bhydrocarbon\b", r"\bflammable\b", r"\btoxic\b"],
    "thermal": [r"\bhot work\b", r"\bwelding\b", r"\bsteam\b", r"\bmolten\b"],
    "kinetic": [r"\bvehicle\b", r"\bcollision\b", r"\bstruck by\b", r"\bhose whip\b"],
}
PROXIMITY_PATTERNS = [
    r"\bline of fire\b", r"\bunder (the )?load\b", r"\bstanding under\b", r"\bclose proximity\b",
    r"\bwithin the drop zone\b", r"\bpath of travel\b", r"\bno exclusion zone\b", r"\bworkers nearby\b",
]
BARRIER_FAILURE_PATTERNS = [
    r"\bno (permit|Permit to Work)\b", r"\bwithout (a )?permit\b", r"\bpermit.{0,24}expired\b", r"\bpermit (expired|not issued|missing)\b", r"\bnot isolated\b",
    r"\block-out tag-out not\b", r"\bLOTO not\b", r"\bbypass(ed)?\b", r"\bmissing (harness|guard|attendant|fire watch|tag line)\b",
    r"\bno gas test\b", r"\binterlock defeated\b", r"\bwithout authorization\b", r"\bguard removed\b",
]
# Phrases that weigh more among a narrative's evidence, and the two weights.
CRITICAL_PHRASES = ("not isolated", "bypass", "dropped", "h2s", "hydrogen", "no permit")
CRITICAL_WEIGHT, PHRASE_WEIGHT, MOST_PHRASES = 0.92, 0.7, 8

# Labelling functions.
HIGH_ENERGY = ("electrical", "pressure", "chemical", "gravity", "thermal")
HEIGHT = r"\b(fall from|no harness|dropped object|working at height|incomplete scaffold)\b"
CONFINED = r"\b(confined space|hydrogen sulfide|no gas test|toxic atmosphere)\b"
LIFTING = r"\b(suspended load|under the load|crane|sling failure|SWL exceeded)\b"
ROUTINE_NOISE = r"\b(housekeeping|slippery floor|missing glove|hard hat not worn|trip hazard|poor housekeeping)\b"

# Cues of the challenge queue.
DIRECT_CUES = r"\b(fatality|fatal|killed|explosion|arc\s*flash|h2s|hydrogen\s+sulfide|confined\s+space|line\s+of\s+fire|dropped\s+object|fall\s+from|energized|LOTO|lock[\s-]?out|high\s+pressure|rupture)\b"
INDIRECT_CUES = r"\b(almost|nearly|could\s+have|potential|might\s+have| narrowly|without\s+injury|no\s+injury|fortunately|lucky|close\s+call)\b"
ROUTINE_CUES = r"\b(housekeeping|slippery|missing\s+glove|hard\s+hat|trip\s+hazard|signage|spill\s+of\s+water|paperwork|documentation)\b"
UNSEEN_TERMS = r"\b(pigging|hydrate|BOP|blowout|frac\s*tree|Christmas\s+tree|annulus|wireline|coiled\s+tubing|sour\s+gas|mercaptan|catalytic\s+cracker|hydrocracker|flare\s+knockout)\b"

# Plain patterns of personal data and what stands in their place, in the order of replacement.
PERSONAL_PATTERNS = [
    (r"\bEMP[- ]?\d{3,8}\b", "[ID]"),
    (r"\b(?:OIL|EMP)[- ]?\d{4,10}\b", "[ID]"),
    (r"\b(?:OIL|EMP)ID[:\s-]*\d{4,10}\b", "[ID]"),
    (r"\b\d{10}\b", "[PHONE]"),
    (r"\+91[-\s]?\d(?:[\s-]?\d){9}\b", "[PHONE]"),
    (r"\b\d{3}[-.\ ]\d{3}[-.\ ]\d{4}\b", "[PHONE]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
]
# Narratives that state a control in place, or a bare movement of material, assert nothing.
CONFIRMED_CONTROL = r"\b(?:isolation|permit to work|ptw)\s+(?:was\s+)?(?:valid|verified|confirmed|approved|complete)\b"
SPARSE_MATERIAL = r"\bforklift\b.*\bpipe bundles?\b"

# Concepts of each rule; those of different groups must occur together in one sentence.
CONCEPT_PROFILES = {
    "LSR01": (("bypass", "override", "disable", "defeat", "inhibit", "jumper"), ("interlock", "trip", "alarm", "guard", "limit switch", "safety control")),
    "LSR02": (("enter", "entry", "access", "ingress", "manway"), ("atmosphere", "atmospheric", "air", "gas", "vapour", "oxygen", "h2s"), ("test", "verify", "verified", "monitor", "sample", "check")),
    "LSR03": (("driver", "driving", "vehicle", "truck", "car", "journey"), ("speed", "seat belt", "restraint", "distraction", "phone", "revers")),
    "LSR04": (("isolate", "lockout", "tagout", "loto", "depressurize", "vent", "bleed", "zero energy"), ("energy", "pressure", "electrical", "live", "hydraulic", "valve", "panel")),
    "LSR05": (("weld", "grind", "torch", "cut", "spark", "hot work"), ("flammable", "combustible", "vapour", "ignition", "fire watch", "gas test", "hydrocarbon")),
    "LSR06": (("under", "line of fire", "drop zone", "pinch", "struck", "crush", "trajectory", "whip"), ("load", "object", "hose", "pressure", "moving", "release", "debris")),
    "LSR07": (("crane", "hoist", "rigging", "sling", "lift", "lifting", "forklift"), ("load", "rated", "capacity", "overload", "suspended", "shackle", "tag line")),
    "LSR08": (("permit", "ptw", "authorization", "clearance", "jsa", "toolbox"), ("without", "missing", "expired", "valid", "before", "commence", "start", "work")),
    "LSR09": (("height", "scaffold", "ladder", "platform", "roof", "elevated", "catwalk"), ("harness", "lanyard", "fall arrest", "anchor", "fall", "edge protection")),
}
CONCEPT_MATCH, CONCEPT_CONFIRMS = 0.52, 0.48

# Taxonomies of precursors: (name, rule, patterns, patterns of paraphrases), in the order in which the first counts.
ACTIVITIES = [
    ("Line dismantling / piping break", "LSR04", [r"\b(dismantl|disassembl|uncoupl|remov|disconnect|break(ing)?)\w*\s+(the\s+)?(?:(?:pressur\w+|live|process)\s+)?(pipe|line|flange|tubing|manifold)", r"\bline\s+break(ing)?\b", r"\bflange\s+(opening|removal|unbolting)\b"], [r"\b(opened|broke\s+open|separated)\s+(the\s+)?(?:(?:pressur\w+|process)\s+)?(pipe|line|flange)\b"]),
    ("Hot work / welding", "LSR05", [r"\b(weld(ed|ing)?|torch\s+cut(ting)?|grind(ing)?|flame\s+work|brazing)\b"], []),
    ("Mechanical lifting", "LSR07", [r"\b(crane|rigging|lifting|hoist(ing)?|winch(ing)?)\b"], []),
    ("Confined space entry", "LSR02", [r"\b(confined\s+space|tank\s+entry|vessel\s+entry|entering\s+cellar|pit\s+entry)\b"], []),
    ("Working at height", "LSR09", [r"\b(working\s+at\s+height|scaffold(ing)?|elevated\s+platform|manlift|derrick\s+ladder|mast\s+climbing)\b"], []),
    ("Energy isolation", "LSR04", [r"\b(isolat(ing|ion)|loto|depressuriz(ing|ation)|de-energiz(ing|ation))\b"], []),
    ("Driving / transport", "LSR03", [r"\b(driv(ing)?|vehicle|truck|convoy|forklift\s+operat\w*|tanker\s+transport)\b"], []),
    ("Drilling operations", "LSR08", [r"\b(drilling|trip(ping)?\s+pipe|casing\s+running|top\s+drive|making\s+connection)\b"], []),
    ("Equipment maintenance", "LSR01", [r"\b(mainten(ance)?|repair(ing)?|servic(ing)?|replac(ing)?\s+(seal|filter|pump|valve|bearing))\b"], []),
    ("Excavation / trenching", "LSR08", [r"\b(excavat(ing|ion)|trench(ing)?|digging\s+pit|earthwork)\b"], []),
]
BARRIERS = [
    ("Isolation not verified", "LSR04", [r"\b(without\s+(confirming|verifying|checking)\s+isolation)\b", r"\b(not\s+isolated|unisolated|residual\s+pressure\s+remained)\b", r"\b(loto\s+not\s+applied|lockout\s+not\s+applied|no\s+loto)\b", r"\b(unverified\s+zero\s+energy)\b"], [r"\b(without|before)\s+(proving|ensuring|confirming|verifying)\s+(?:that\s+)?(?:it|the\s+(?:line|system))\s+(?:was\s+)?isolat\w*\b"]),
    ("Missing / expired PTW", "LSR08", [r"\b(no\s+permit|permit\s+(expired|missing)|without\s+(valid\s+)?(ptw|permit))\b", r"\bunauthorized\s+work\b"], []),
    ("Missing fall protection", "LSR09", [r"\b(no\s+harness|without\s+(safety\s+)?harness|harness\s+(unhooked|unclipped|not\s+anchored))\b", r"\b(missing\s+fall\s+(arrest|protection)|no\s+lifeline)\b"], []),
    ("Atmosphere not verified", "LSR02", [r"\b(atmospheric\s+conditions?\s+(were\s+)?not\s+verified)\b", r"\b(no\s+gas\s+test|gas\s+testing\s+not\s+done|gas\s+test\s+omitted)\b", r"\b(toxic\s+gas\s+not\s+checked|oxygen\s+level\s+not\s+measured)\b"], []),
    ("Safety control bypassed", "LSR01", [r"\b(interlock\s+(defeated|jumpered)|bypass(ed)?\s+safety\s+control|safety\s+device\s+bridged)\b", r"\b(tampered\s+sensor|overridden\s+shutdown)\b"], []),
    ("No attendant / stand-by", "LSR02", [r"\b(no\s+attendant|missing\s+attendant|without\s+standby|unattended\s+entry)\b"], []),
    ("No fire watch", "LSR05", [r"\b(no\s+fire\s+watch|fire\s+watch\s+(missing|absent)|without\s+fire\s+watch)\b"], []),
    ("Lifting barrier failed", "LSR07", [r"\b(damaged\s+sling|defective\s+shackle|swl\s+exceeded|rigging\s+failed)\b", r"\b(uninspected\s+lifting\s+tackle|improper\s+rigging)\b"], []),
    ("Line-of-fire control missing", "LSR06", [r"\b(line\s+of\s+fire|no\s+exclusion\s+zone|under\s+(suspended\s+)?load|in\s+the\s+drop\s+zone)\b"], []),
    ("Machine guarding defeated", "LSR01", [r"\b(guard\s+removed|missing\s+guard|rotating\s+parts\s+exposed|unguarded\s+coupling)\b"], []),
    ("PPE not worn / inadequate", None, [r"\b(without\s+(face\s+shield|safety\s+glasses|ppe|respirator)|ppe\s+not\s+worn|missing\s+ppe)\b"], []),
]
HAZARDS = [
    ("Stored / pressurized energy", "LSR04", [r"\b(pressur\w+\s+(line|gas|liquid|fluid|circuit|vessel)|residual\s+pressure|hydraulic\s+pressure|compressed\s+air)\b", r"\bpressur(ized|e)\b"], [r"\b(pressure\s+(?:had\s+)?not\s+been\s+(?:released|bled\s+down|vented)|trapped\s+pressure)\b"]),
    ("Hazardous toxic gas (H2S / VOC)", "LSR02", [r"\b(h2s|hydrogen\s+sulfide|sour\s+gas|toxic\s+(gas|vapor|fumes)|hydrocarbon\s+vapor)\b"], []),
    ("High voltage electrical energy", "LSR04", [r"\b(high\s+voltage|electrical\s+arc(\s+flash)?|live\s+(cable|conductor|switchgear|busbar)|electric\s+shock)\b"], []),
    ("Suspended mechanical load", "LSR07", [r"\b(suspended\s+load|overhead\s+crane|falling\s+object|dropped\s+object|drop\s+hazard)\b"], []),
    ("Fall from height", "LSR09", [r"\b(fall\s+from\s+height|fall\s+hazard|elevated\s+work|open\s+edge|floor\s+opening)\b"], []),
    ("Thermal / fire / explosion", "LSR05", [r"\b(fire|explosion|ignit\w+|flash\s+fire|flammable\s+mixture|hot\s+surface)\b"], []),
    ("Kinetic / moving machinery", "LSR06", [r"\b(rotating\s+(shaft|equipment)|nip\s+point|moving\s+machinery|pinch\s+point|crush\w*)\b"], []),
]
LOCATIONS = [
    ("wellhead", [r"\bwellhead\b", r"\bx-mas tree\b", r"\bchristmas tree\b"]),
    ("rig floor", [r"\brig\s+floor\b", r"\bdrill\s+floor\b", r"\brotary\s+table\b"]),
    ("mud tank", [r"\bmud\s+tank\b", r"\bshaker\s+tank\b", r"\bmud\s+pit\b"]),
    ("pipeline ROW", [r"\bpipeline(\s+row)?\b", r"\bright\s+of\s+way\b", r"\bflowline\b"]),
    ("workshop", [r"\bworkshop\b", r"\bmachine\s+shop\b", r"\bfabrication\s+yard\b"]),
    ("warehouse", [r"\bwarehouse\b", r"\bmaterials\s+store\b"]),
    ("well cellar", [r"\b(well\s+)?cellar\b", r"\bcellar\s+pit\b"]),
    ("tank farm", [r"\btank\s+farm\b", r"\bstorage\s+tank\b", r"\boil\s+tank\b", r"\bbullet\s+tank\b"]),
    ("electrical panel / MCC", [r"\belectrical\s+panel\b", r"\bMCC(\s+room)?\b", r"\bsubstation\b", r"\bswitchgear\b"]),
    ("flare area", [r"\bflare(\s+area|\s+pit|\s+stack)?\b"]),
    ("scaffold platform", [r"\bscaffold(\s+platform)?\b", r"\bstaging\b"]),
    ("compressor house", [r"\bcompressor\s+house\b", r"\bgas\s+plant\b", r"\bGCS\b"]),
]
NO_EQUIPMENT = ("general", "unspecified", "none", "n/a", "unknown")
# Confidence of a field by how it was found, and of a precursor by the number of its dimensions.
METHOD_CONFIDENCE = {"rule": 0.98, "semantic_pattern": 0.86}
DIMENSION_CONFIDENCE = {0: 0.40, 1: 0.70, 2: 0.85, 3: 0.92, 4: 0.92}
