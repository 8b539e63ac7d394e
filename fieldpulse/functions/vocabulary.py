"""Label vocabularies and body measures.

Everything in this module is a set of fixed values: raw labels as they occur in
the source data, the class each one belongs to, and mean body measures per
position. A cleaned result is only right if these values are exactly these.
"""

from __future__ import annotations

# Stadium label -> class. Null counts as outdoor.
STADIUM = {
    "Outdoor": "Outdoor",
    "Indoors": "Indoor",
    "Oudoor": "Outdoor",
    "Outdoors": "Outdoor",
    "Open": "Outdoor",
    "Closed Dome": "Indoor",
    "Domed, closed": "Indoor",
    "Dome": "Indoor",
    "Indoor": "Indoor",
    "Domed": "Indoor",
    "Retr. Roof-Closed": "Indoor",
    "Outdoor Retr Roof-Open": "Outdoor",
    "Retractable Roof": "Indoor",
    "Ourdoor": "Outdoor",
    "Indoor, Roof Closed": "Indoor",
    "Retr. Roof - Closed": "Indoor",
    "Bowl": "Outdoor",
    "Outddors": "Outdoor",
    "Retr. Roof-Open": "Outdoor",
    "Dome, closed": "Indoor",
    "Indoor, Open Roof": "Outdoor",
    "Domed, Open": "Outdoor",
    "Domed, open": "Outdoor",
    "Heinz Field": "Outdoor",
    "Cloudy": "Outdoor",
    "Retr. Roof - Open": "Outdoor",
    "Retr. Roof Closed": "Indoor",
    "Outdor": "Outdoor",
    "Outside": "Outdoor",
    "outdoor": "Outdoor",
    "Outdoors ": "Outdoor",
    "Indoor, non-retractable roof": "Indoor",
    "Retr. roof - closed": "Indoor",
    "Indoor, fixed roof ": "Indoor",
    "Indoor, Non-Retractable Dome": "Indoor",
    "Indoor, Fixed Roof": "Indoor",
    "Indoor, fixed roof": "Indoor",
    "Indoors (Domed)": "Indoor",
}

# The first version of the vocabulary knew only the labels above up to this one.
_LAST_EARLY = "Outside"
EARLY_STADIUM = {
    raw: STADIUM[raw] for raw in list(STADIUM)[: list(STADIUM).index(_LAST_EARLY) + 1]
}

# Play label -> class.
PLAY = {
    "Kickoff Not Returned": "Kickoff",
    "Kickoff Returned": "Kickoff",
    "Punt Not Returned": "Punt",
    "Punt Returned": "Punt",
    "0": "Unknown",
}

# Weather label -> class, case-sensitive.
WEATHER = {
    "Clear and warm": "Clear",
    "Mostly Cloudy": "Cloudy",
    "Sunny": "Clear",
    "Clear": "Clear",
    "Cloudy": "Cloudy",
    "Cloudy, fog started developing in 2nd quarter": "Hazy/Fog",
    "Rain": "Rain",
    "Partly Cloudy": "Cloudy",
    "Mostly cloudy": "Cloudy",
    "Cloudy and cold": "Cloudy",
    "Cloudy and Cool": "Cloudy",
    "Rain Chance 40%": "Rain",
    "Controlled Climate": "Indoor",
    "Sunny and warm": "Clear",
    "Partly cloudy": "Cloudy",
    "Clear and Cool": "Cloudy",
    "Clear and cold": "Cloudy",
    "Sunny and cold": "Clear",
    "Indoor": "Indoor",
    "Partly Sunny": "Clear",
    "N/A (Indoors)": "Indoor",
    "Mostly Sunny": "Clear",
    "Indoors": "Indoor",
    "Clear Skies": "Clear",
    "Partly sunny": "Clear",
    "Showers": "Rain",
    "N/A Indoor": "Indoor",
    "Sunny and clear": "Clear",
    "Snow": "Snow",
    "Scattered Showers": "Rain",
    "Party Cloudy": "Cloudy",
    "Clear skies": "Clear",
    "Rain likely, temps in low 40s.": "Rain",
    "Hazy": "Hazy/Fog",
    "Partly Clouidy": "Cloudy",
    "Sunny Skies": "Clear",
    "Overcast": "Cloudy",
    "Cloudy, 50% change of rain": "Cloudy",
    "Fair": "Clear",
    "Light Rain": "Rain",
    "Partly clear": "Clear",
    "Mostly Coudy": "Cloudy",
    "10% Chance of Rain": "Cloudy",
    "Cloudy, chance of rain": "Cloudy",
    "Heat Index 95": "Clear",
    "Sunny, highs to upper 80s": "Clear",
    "Sun & clouds": "Cloudy",
    "Heavy lake effect snow": "Snow",
    "Mostly sunny": "Clear",
    "Cloudy, Rain": "Rain",
    "Sunny, Windy": "Windy",
    "Mostly Sunny Skies": "Clear",
    "Rainy": "Rain",
    "30% Chance of Rain": "Rain",
    'Cloudy, light snow accumulating 1-3"': "Snow",
    "cloudy": "Cloudy",
    "Clear and Sunny": "Clear",
    "Coudy": "Cloudy",
    "Clear and sunny": "Clear",
    "Clear to Partly Cloudy": "Clear",
    "Cloudy with periods of rain, thunder possible. Winds shifting to WNW, 10-20 mph.": "Windy",
    "Rain shower": "Rain",
    "Cold": "Clear",
    "Partly cloudy, lows to upper 50s.": "Cloudy",
    "Scattered thunderstorms": "Rain",
    "CLEAR": "Clear",
    "Partly CLoudy": "Cloudy",
    "Chance of Showers": "Rain",
    "Snow showers": "Snow",
    "Clear and Cold": "Clear",
    "Cloudy with rain": "Rain",
    "Sunny intervals": "Clear",
    "Clear and cool": "Clear",
    "Cloudy, Humid, Chance of Rain": "Rain",
    "Cloudy and Cold": "Cloudy",
    "Cloudy with patches of fog": "Hazy/Fog",
    "Controlled": "Indoor",
    "Sunny and Clear": "Clear",
    "Cloudy with Possible Stray Showers/Thundershowers": "Rain",
    "Suny": "Clear",
    "T-Storms": "Rain",
    "Sunny and cool": "Clear",
    "Cloudy, steady temps": "Cloudy",
    "Hazy, hot and humid": "Hazy/Fog",
    "Sunny Intervals": "Clear",
    "Partly Cloudy, Chance of Rain 80%": "Rain",
    "Mostly Clear. Gusting ot 14.": "Windy",
    "Mostly CLoudy": "Cloudy",
    "Snow Showers, 3 to 5 inches expected.": "Snow",
}

# Turf label -> class. Null counts as natural.
TURF = {
    "Grass": "Natural",
    "Field Turf": "Synthetic",
    "Natural Grass": "Natural",
    "grass": "Natural",
    "Artificial": "Synthetic",
    "FieldTurf": "Synthetic",
    "DD GrassMaster": "Synthetic",
    "A-Turf Titan": "Synthetic",
    "UBU Sports Speed S5-M": "Synthetic",
    "UBU Speed Series S5-M": "Synthetic",
    "Artifical": "Synthetic",
    "UBU Speed Series-S5-M": "Synthetic",
    "FieldTurf 360": "Synthetic",
    "Natural grass": "Natural",
    "Field turf": "Synthetic",
    "Natural": "Natural",
    "Natrual Grass": "Natural",
    "Synthetic": "Synthetic",
    "Natural Grass ": "Natural",
    "Naturall Grass": "Natural",
    "FieldTurf360": "Synthetic",
}

# Position, mean height in m, mean weight in kg, chest radius in m.
BODY = [
    ("QB", 1.91, 102.1, 0.191),
    ("RB", 1.79, 95.3, 0.191),
    ("FB", 1.85, 111.1, 0.191),
    ("WR", 1.88, 90.7, 0.191),
    ("TE", 1.96, 114.6, 0.191),
    ("T", 1.97, 140.6, 0.191),
    ("G", 1.90, 141.8, 0.191),
    ("C", 1.87, 136.1, 0.191),
    ("DE", 1.97, 120.2, 0.191),
    ("DT", 1.92, 141.8, 0.191),
    ("NT", 1.88, 152.0, 0.191),
    ("LB", 1.90, 110.0, 0.191),
    ("OLB", 1.90, 108.9, 0.191),
    ("MLB", 1.87, 113.4, 0.191),
    ("CB", 1.82, 87.4, 0.191),
    ("S", 1.84, 95.9, 0.191),
    ("K", 1.83, 92.08, 0.191),
    ("P", 1.88, 97.52, 0.191),
    ("SS", 1.84, 95.9, 0.191),
    ("ILB", 1.90, 110.0, 0.191),
    ("FS", 1.84, 95.9, 0.191),
    ("LS", 1.88, 108.86, 0.191),
    ("DB", 1.82, 87.4, 0.191),
]

# Known game-event labels.
EVENTS = [
    "ball_snap", "drop_kick", "end_path", "extra_point", "extra_point_attempt",
    "extra_point_blocked", "extra_point_fake", "extra_point_missed", "fair_catch", "field_goal",
    "field_goal_attempt", "field_goal_blocked", "field_goal_fake", "field_goal_missed",
    "field_goal_play", "first_contact", "free_kick", "free_kick_play", "fumble",
    "fumble_defense_recovered", "fumble_offense_recovered", "handoff", "huddle_break_offense",
    "huddle_start_offense", "kick_received", "kick_recovered", "kickoff", "kickoff_land",
    "kickoff_play", "lateral", "line_set", "man_in_motion", "onside_kick", "out_of_bounds",
    "pass_arrived", "pass_forward", "pass_lateral", "pass_outcome_caught",
    "pass_outcome_incomplete", "pass_outcome_interception", "pass_outcome_touchdown",
    "pass_shovel", "pass_tipped", "penalty_accepted", "penalty_declined", "penalty_flag",
    "play_action", "play_submit", "punt", "punt_blocked", "punt_downed", "punt_fake", "punt_land",
    "punt_muffed", "punt_play", "punt_received", "qb_kneel", "qb_sack", "qb_spike",
    "qb_strip_sack", "run", "run_pass_option", "safety", "shift", "snap_direct", "tackle",
    "timeout", "timeout_away", "timeout_booth_review", "timeout_halftime", "timeout_home",
    "timeout_injury", "timeout_quarter", "timeout_tv", "touchback", "touchdown",
    "two_minute_warning", "two_point_conversion", "two_point_play", "xp_fake",
]

# Position groups used for modelling.
POSITION_GROUPS = {
    "Offensive": ["WR", "RB", "TE", "T", "C"],
    "Linebackers": ["ILB", "OLB", "MLB", "LB", "DE", "DT"],
    "Defensive": ["CB", "FS", "SS", "DB"],
}

# Play types kept for modelling, and the ones joined into one class.
MODEL_PLAY_TYPES = ["Pass", "Rush", "Kickoff", "Punt"]
SPECIAL_PLAY_TYPES = ["Kickoff", "Punt"]

# The viewing windows of seven plays, seconds from the start.
VIEWING_WINDOWS = [
    ("23742-274-3609", 15.0, 23.0),
    ("26035-399-3312", 8.0, 16.0),
    ("27595-189-3509", 9.0, 17.0),
    ("28620-234-3278", 16.0, 24.0),
    ("32323-364-2764", 5.0, 13.0),
    ("32783-296-2667", 18.0, 26.0),
    ("33260-601-602", 27.0, 34.0),
]

# Named character references of web pages.
REFERENCES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "iexcl": "¡",
    "cent": "¢", "pound": "£", "yen": "¥", "sect": "§", "copy": "©", "laquo": "«", "reg": "®",
    "deg": "°", "plusmn": "±", "sup2": "²", "sup3": "³", "acute": "´", "micro": "µ", "para": "¶",
    "middot": "·", "raquo": "»", "frac14": "¼", "frac12": "½", "frac34": "¾", "iquest": "¿",
    "times": "×", "divide": "÷", "szlig": "ß", "agrave": "à", "aacute": "á", "acirc": "â",
    "atilde": "ã", "auml": "ä", "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê",
    "euml": "ë", "iacute": "í", "ntilde": "ñ", "oacute": "ó", "ocirc": "ô", "ouml": "ö",
    "uacute": "ú", "uuml": "ü", "Auml": "Ä", "Eacute": "É", "Ntilde": "Ñ", "Ouml": "Ö", "Uuml": "Ü",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "bull": "•", "hellip": "…", "euro": "€", "trade": "™", "larr": "←", "rarr": "→",
}
