"""Word lists, patterns and lookup tables."""

# Terms, patterns and codes that results must agree on.
POSITIVE_LEXICON = {
    "physiological": [
        "sweat", "sweating", "sweaty", "drenched in sweat", "sticky", "clammy", "parched", "dehydrated", "thirsty",
        "dry throat", "heatstroke", "heat exhaustion", "dizzy", "lightheaded", "overheated", "overheating", "flushed",
        "red-faced", "heat stress", "heat fatigue", "heat rash", "nausea", "fainting", "muscle cramps",
        "rapid heartbeat", "breathing difficulty", "suffocating heat", "oppressive heat",
    ],
    "psychological": [
        "can't focus", "too hot to focus", "uncomfortable", "restless", "frustrated", "irritated", "drained",
        "sluggish", "fatigued", "mental exhaustion", "heat-induced anxiety", "overwhelmed", "short-tempered",
        "distracted", "too hot to sleep", "cannot sleep", "can't sleep", "miserable in this heat",
    ],
    "coping_individual": [
        "turned on the ac", "turned on the air conditioning", "air conditioner", "air conditioning", "ac on", "need ac",
        "seeking shade", "rest in the shade", "find cool spots", "cool down", "cold shower", "drink cold water",
        "drink iced tea", "go swimming", "jump in the pool", "portable fan", "ice pack", "stay hydrated",
        "wear light clothes", "avoid physical activity", "spray water mist", "cooling towel",
    ],
    "coping_social": [
        "cooling center", "cooling centre", "community cooling", "cooling station", "urban green space", "green space",
        "urban trees", "heatwave shelter", "heat shelter", "emergency shelter", "heat relief", "heat refuge",
        "urban tree planting", "tree canopy", "heat resilience", "heat action plan", "energy overload", "power grid",
        "heat emergency services", "heat helpline",
    ],
    "ambient_heat": [
        "hot", "heat", "heatwave", "heat wave", "sweltering", "boiling", "scorching", "blazing", "searing", "torrid",
        "sizzling", "temperature", "hottest day", "record heat", "heat index", "humidity", "heat dome", "extreme heat",
        "high temperature", "urban heat",
    ],
}
FIRST_PERSON = [r"\bi\b", r"\bim\b", r"\bi'm\b", r"\bive\b", r"\bi've\b", r"\bme\b", r"\bmy\b", r"\bmyself\b", r"\bwe\b", r"\bwe're\b", r"\bours\b", r"\bus\b"]
OUTDOOR = [
    r"\boutside\b", r"\boutdoors\b", r"\bwalking\b", r"\bwalked\b", r"\bbus stop\b", r"\bon the bus\b", r"\bon the train\b",
    r"\bon the street\b", r"\bin the sun\b", r"\bin traffic\b", r"\bcommute\b", r"\bpark\b", r"\bbeach\b", r"\bshade\b",
    r"\bqueue\b", r"\bline outside\b", r"\boutside at work\b",
]
NEGATION = [
    r"\bnot\s+(?:too\s+)?hot\b", r"\bnot\s+feeling\s+hot\b", r"\bno\s+heat\s+today\b", r"\bno\s+hot\s+weather\b",
    r"\bwasn['’]?t\s+hot\b", r"\bisn['’]?t\s+hot\b", r"\baren['’]?t\s+hot\b", r"\bnever\s+gets\s+hot\b", r"\bwithout\s+heat\b",
]
RULE_FIRST_PERSON = [r"\bi\b", r"\bi'm\b", r"\bme\b", r"\bmy\b", r"\bwe\b", r"\bours\b", r"\bus\b"]
RULE_OUTDOOR = [
    r"\boutside\b", r"\boutdoors\b", r"\bwalking\b", r"\bwalk home\b", r"\bwalked\b", r"\bon the bus\b", r"\bbus stop\b",
    r"\bstreet\b", r"\bshade\b", r"\bin the sun\b", r"\bcommute\b", r"\boutside at work\b",
]
RULE_DEICTIC = [r"\btoday\b", r"\bright now\b", r"\bthis afternoon\b", r"\bthis morning\b", r"\bon my way\b"]
RULE_PHYSIOLOGY = [
    r"\bsweat\w*\b", r"\bdehydrat\w*\b", r"\bthirsty\b", r"\bdizzy\b", r"\blightheaded\b", r"\boverheat\w*\b", r"\bnausea\b",
    r"\bheat exhaustion\b", r"\bheat stroke\b", r"\bcan't focus\b", r"\btoo hot to sleep\b", r"\bcold shower\b", r"\bshade\b",
    r"\bac\b", r"\bair conditioning\b",
]
EXCLUSION_RULES = [
    ("policy_advocacy_news", "policy_or_climate_discourse", [
        r"\bglobal warming\b", r"\bclimate change\b", r"\bclimate action\b", r"\bcarbon emissions\b", r"\bgreenhouse effect\b",
        r"\burban heat island\b", r"\bheat resilience\b", r"\bheat mitigation\b", r"\bclimate emergency\b", r"\bpolicy\b",
        r"\badvocacy\b",
    ]),
    ("policy_advocacy_news", "news_alert_forecast", [
        r"\bheat warning\b", r"\bheat advisory\b", r"\bwarning issued\b", r"\bforecast\b", r"\bheadline\b", r"\bnews\b",
        r"\breport\b", r"\bbreaking\b", r"\brecord heat\b", r"\bhottest day\b", r"\bweather report\b", r"\btemperature record\b",
    ]),
    ("metaphorical_figurative", "trendiness_or_popularity", [
        r"\bhot topic\b", r"\bhot take\b", r"\btrending\b", r"\bhot and trending\b", r"\bhot off the press\b", r"\bcatchy tune\b",
        r"\bpopular\b", r"\bheat up sales\b", r"\bheating up\b",
    ]),
    ("metaphorical_figurative", "attractiveness_or_emotion", [
        r"\bshe looks hot\b", r"\bhe looks hot\b", r"\bso hot\s*!?$", r"\bheated argument\b", r"\bhot mess\b", r"\bhot streak\b",
        r"\bhot seat\b",
    ]),
    ("product_media_technical", "media_titles", [
        r"\bthe movie heat\b", r"\bmovie heat\b", r"\bhot stuff\b", r"\bheat soundtrack\b", r"\balbum\b", r"\bsong\b",
        r"\bepisode\b", r"\bnetflix\b", r"\bspotify\b",
    ]),
    ("product_media_technical", "commercial_or_business", [
        r"\bhot deal\b", r"\bhot deals\b", r"\bselling like hotcakes\b", r"\bhot market\b", r"\bhot stock\b", r"\bhot property\b",
        r"\bhot offers\b", r"\bhot leads\b",
    ]),
    ("product_media_technical", "scientific_or_technical", [
        r"\bheat transfer\b", r"\blatent heat\b", r"\bspecific heat\b", r"\bheat exchanger\b", r"\bheat capacity\b",
        r"\bgpu overheating\b", r"\bhot swapping\b", r"\bheat pump\b",
    ]),
    ("indoor_heating_food", "indoor_temperature_control", [
        r"\bheater\b", r"\bradiator\b", r"\bcentral heating\b", r"\bwarm indoors\b", r"\bturn down the radiator\b",
        r"\bhome into a sauna\b",
    ]),
    ("indoor_heating_food", "food_or_drink", [
        r"\bhot pot\b", r"\bhot sauce\b", r"\bhot wings\b", r"\bhot chocolate\b", r"\bhot & sour\b", r"\bspicy heat\b",
        r"\bhot cider\b", r"\bhot cross buns\b", r"\bhot tamales\b",
    ]),
    ("proper_nouns_events", "sports_charts_events", [
        r"\bmiami heat\b", r"\bbillboard hot 100\b", r"\bheat wave festival\b", r"\bhot springs\b", r"\bhot air balloon festival\b",
    ]),
    ("proper_nouns_events", "other_named_entities", [r"\bdeath valley\b", r"\bheat magazine\b"]),
]
PROMOTION = [r"\bbuy now\b", r"\blimited offer\b", r"\bpromo\b", r"\bdiscount\b", r"\bshop now\b", r"\blink in bio\b", r"\bsubscribe\b", r"\baffiliate\b", r"\bsponsored\b", r"\bsale\b"]
REPOSTS = [r"^rt\s+@", r"^qt\s+@"]
ACCOUNT_COLUMNS = ["user_id", "account_id", "username", "screen_name", "user_name", "author_id"]
SOUTHERN_COUNTRIES = ["AUS", "NZL", "FJI", "ARG", "BRA", "CHL", "URY", "PRY", "ZAF"]
NORTHERN_COUNTRIES = ["KEN", "EGY", "COL", "USA", "CAN", "MEX", "GBR", "DEU", "ESP", "FRA", "ITA", "IND", "JPN", "PHL", "CHN"]
SOUTHERN_CONTINENTS = ["oceania", "south america"]
CITY_POOL = {
    "Africa": ["EGY", "KEN", "ZAF"],
    "Asia": ["IND", "JPN", "PHL"],
    "Europe": ["DEU", "ESP", "GBR"],
    "North America": ["CAN", "MEX", "USA"],
    "South America": ["ARG", "BRA", "COL"],
    "Oceania": ["AUS", "NZL", "FJI"],
}
GOLD_COLUMNS = [
    "sample_id", "tweet_id", "sentence", "label", "city_id", "continent", "country", "month", "original_split", "source_platform",
    "metadata_is_synthetic", "needs_metadata_backfill", "is_synthetic_example", "synthetic_example_type",
]
CLASS_NAMES = {"all-cause": "All-cause", "age0_69": "Age 0-69", "age70_": "Age 70+", "female": "Female", "male": "Male"}
CITY_NAMES = {
    "mexico city": "Mexico City",
    "puerto vallarta": "Puerto Vallarta",
    "playa del carmen": "Playa del Carmen (b)",
    "porto alegre": "Porto Alegre",
    "rio de janeiro": "Rio de Janeiro",
}
OUTCOME_LABELS = {"Death": "Death", "Hospitlization": "Hospitalization", "Emergency department visit": "Emergency\ndept. visits"}
OUTCOME_TYPES = {"Death": "Death", "Hospitalization": "Hospitlization", "ED": "Emergency department visit"}
# End of fixed values.
