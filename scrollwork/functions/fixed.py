"""Word lists, patterns, tables and limits that decide results.

They are plain data. Every operator takes them as a default argument, so users can
pass their own.
"""

# --- Fixed values: section intents, in order of preference on equal scores ---
INTENT_PATTERNS = [
    ("setting", [r"\bworld\b", r"\bsetting\b", r"\bhistory\b", r"\bdarkness\b", r"\bplaces?\b", r"\bintroduction\b"]),
    ("factions", [r"\btraditions?\b", r"\bfactions?\b", r"\bclans?\b", r"\bsects?\b", r"\borganizations?\b"]),
    ("mechanics", [r"\brules?\b", r"\bspheres?\b", r"\bmagic\b", r"\bcombat\b", r"\bcharacter\s+creation\b",
                   r"\btraits?\b", r"\bdisciplines?\b", r"\bpowers?\b"]),
    ("characters", [r"\bnpcs?\b", r"\bcharacters?\b", r"\barchetypes?\b", r"\btemplates?\b"]),
    ("narrative", [r"\bprologue\b", r"\bfiction\b", r"\bchronicle\b", r"\bstory\b"]),
    ("reference", [r"\bappendix\b", r"\bglossary\b", r"\bindex\b", r"\btables?\b"]),
    ("meta", [r"\bcopyright\b", r"\bcredits?\b", r"\btable\s+of\s+contents\b", r"\bcontents\b", r"\bisbn\b",
              r"\backnowledg\w+\b", r"\ball\s+rights\s+reserved\b", r"\bpublished\s+by\b", r"\bprinted\s+in\b",
              r"\bedition\b", r"\bforeword\b", r"\bcolophon\b", r"\blegal\s+notice\b", r"\btrademark\b",
              r"\bopen\s+game\s+licen[sc]e\b", r"\bogl\b", r"\bdireitos\s+reservados\b", r"\bproibid[ao]?\b",
              r"\breproduc[ãa]o\b", r"\btodos\s+os\s+direitos\b", r"\bpublicado\s+por\b", r"\bimpresso\s+em\b",
              r"^blank\s+page$"]),
    ("equipment", [r"\bequipment\b", r"\bweapons?\b", r"\bgear\b", r"\bitems?\b"]),
    ("bestiary", [r"\bantagonists?\b", r"\bmonsters?\b", r"\bspirits?\b", r"\bcreatures?\b"]),
]

# --- Fixed values: legal and structural noise ---
BOILERPLATE_PATTERNS = [
    r"\bisbn[\s:\-]*[\dxX\-]{10,}", r"\ball\s+rights\s+reserved\b", r"\bopen\s+game\s+licen[sc]e\b",
    r"\bdireitos\s+reservados\b", r"\btodos\s+os\s+direitos\b", r"\bproibid[ao]?\b", r"\breproduc[ãa]o\b",
    r"\bpublicado\s+por\b",
]
NON_CONTENT_PATTERNS = [
    r"\bisbn[\s:\-]*[\dxX\-]{10,}", r"\ball\s+rights\s+reserved\b", r"\bdireitos\s+reservados\b",
    r"\btodos\s+os\s+direitos\b", r"\bopen\s+game\s+licen[sc]e\b", r"(?m)^page\s+\d+$",
]

# --- Fixed values: rule-text density, counted as one alternation ---
DENSITY_PATTERNS = [
    r"\d+d\d+", r"\b\d+\s*[-–]\s*\d+\b", r"\bDC\s*\d+", r"\bHP\b|\bhit\s+points?\b", r"\bAC\b|\barmor\s+class\b",
    r"\+\d+\s+to\b", r"\bsave\b.*\bDC\b", r"\bthreshold\b", r"\btrigger\s*[:=]", r"\bescalation\b",
    r"\bclock\b.*\b\d+/\d+\b", r"\bheat\b.*\b\d+\b", r"\bharm\b.*\b\d+\b", r"\bcred\b.*\b\d+\b",
    r"\bcritical\s*(success|failure)\b", r"\bmixed\s+success\b", r"\baction\s+type\b", r"\bstat\s+block\b",
    r"\bmodifier\b.*[+-]\d+",
]

# --- Fixed values: content types, in order of preference on equal scores ---
TYPE_PATTERNS = [
    ("location", [r"\bdistrict\b", r"\bneighborhood\b", r"\bbar\b", r"\bclub\b", r"\bbuilding\b", r"\bstreet\b",
                  r"\balley\b", r"\bfloor\b", r"\bentrance\b", r"\bexit\b", r"\blocation\b", r"\bvenue\b"]),
    ("npc", [r"\bage\s*[:=]?\s*\d+", r"\bappearance\b", r"\bpersonality\b", r"\bmotivation\b", r"\bbackground\b",
             r"\bconnection\b", r"\bescalation\s+profile\b", r"\bthreat\s+level\b"]),
    ("faction", [r"\bfaction\b", r"\borganization\b", r"\bgang\b", r"\bcorporation\b", r"\bhierarchy\b",
                 r"\bleadership\b", r"\bterritory\b", r"\binfluence\b", r"\brival\b", r"\bally\b"]),
    ("culture", [r"\bculture\b", r"\bcustom\b", r"\btradition\b", r"\bslang\b", r"\bfashion\b", r"\bmusic\b",
                 r"\bfood\b", r"\britual\b", r"\bsocial\b", r"\bclass\b"]),
    ("item", [r"\bweapon\b", r"\barmor\b", r"\bgear\b", r"\bequipment\b", r"\bitem\b", r"\bcyberware\b",
              r"\baugmentation\b", r"\bcredstick\b", r"\bdevice\b"]),
    ("rules", [r"\brule\b", r"\bmechanic\b", r"\bresolution\b", r"\baction\s+type\b", r"\bclock\b",
               r"\bescalation\b", r"\bcalibration\b"]),
    ("table", [r"\|.*\|.*\|", r"\btable\b.*\bresults?\b", r"\bd\d+\s+result\b"]),
]
# "history" can only be reached through a hint and is ranked after the scored types.
TYPE_ORDER = ["location", "npc", "faction", "culture", "item", "rules", "table", "history"]
TYPE_HINTS = [
    ("setting", ["location", "history", "culture"]), ("factions", ["faction"]), ("mechanics", ["rules"]),
    ("characters", ["npc"]), ("equipment", ["item"]), ("bestiary", ["npc"]), ("reference", ["table", "rules"]),
]
ROUTE_BIAS = [
    ("mechanics", 2.5), ("equipment", 1.0), ("bestiary", 1.5), ("reference", 1.0), ("setting", -1.0),
    ("factions", -0.5), ("characters", -0.5), ("narrative", -2.0), ("unknown", 0.0), ("meta", 0.0),
]
CONTENT_TYPES = ["location", "npc", "faction", "culture", "item", "event", "history", "rules", "table", "general"]
ROUTES = ["lore", "systems", "both"]

# --- Fixed values: entities and file placement ---
TYPE_TO_FILE = [
    ("location", "location"), ("npc", "npc"), ("faction", "faction"), ("culture", "culture"), ("item", "item"),
    ("event", "general"), ("history", "culture"), ("general", "general"),
]
INTENT_TO_ENTITY = [
    ("factions", "faction"), ("characters", "npc"), ("setting", "location"), ("bestiary", "npc"),
    ("equipment", "item"),
]
FILE_DIRS = [
    ("location", "locations"), ("npc", "npcs"), ("faction", "factions"), ("culture", "culture"), ("item", "items"),
]
DIR_TYPES = [(d, t) for t, d in FILE_DIRS]
PROMOTABLE = ["npc", "location", "faction", "item"]
EXPECTED_DIRS = ["locations", "npcs", "factions", "culture", "items"]
LORE_CATEGORIES = [
    ("location", "atmosphere"), ("culture", "atmosphere"), ("npc", "npc_briefings"),
    ("faction", "thread_connections"), ("item", "discoverable"), ("general", "atmosphere"),
]

# --- Fixed values: guidance ---
GUIDANCE_PHRASES = [
    "storytelling", "running the game", "game mastering", "for the gm", "referee", "dungeon master", "narrator",
    "the story", "chronicle", "campaign", "adventures", "scenarios", "playing the game",
]
GUIDANCE_RULES = [
    (r"(GM|DM|Storyteller|Referee|Narrator)\s+(should|can|might|may|must)", "gm_technique", 0.8),
    (r"(players|characters)\s+(feel|experience|encounter|discover)", "player_experience", 0.7),
    (r"\b(pacing|tension|escalat|de-escalat|rhythm|flow)\b", "pacing_advice", 0.7),
    (r"\b(mood|tone|atmosphere|ambiance|feel|genre)\b", "tone_guidance", 0.6),
    (r"\b(scene|encounter|session|chapter)\s+(type|kind|example|structure)", "scene_archetype", 0.7),
    (r"\b(consider|try|avoid|remember|don't forget|keep in mind)\b", "advice_language", 0.5),
]
UNIVERSAL_PATTERNS = [
    r"all\s+(games?|rpgs?|stories)", r"in\s+any\s+(game|story|scenario)", r"general\s+(advice|principle|rule)",
    r"always\s+(consider|remember|try)", r"fundamental\s+(principle|technique)",
]
SPECIFIC_PATTERNS = [
    r"horror\s+(game|story|scenario)", r"(gothic|punk|noir|fantasy|sci-?fi)", r"world\s+of\s+darkness",
    r"vampire|werewolf|mage|changeling", r"this\s+(setting|world|game)",
]

# --- Fixed values: retrieval ---
INPUT_STOP_WORDS = [
    "i", "the", "a", "an", "to", "at", "in", "on", "is", "it", "do", "go", "my", "me", "and", "or", "but", "not",
    "can", "with", "for", "of", "this", "that", "what", "want", "look",
]
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6

# --- Fixed values: log and time ---
REQUIRED_EVENT_FIELDS = [
    "id", "campaign_id", "turn_no", "player_input", "context_packet", "pass_outputs", "engine_events",
    "state_diff", "final_text", "prompt_versions",
]
DAY_PERIODS = [(5, 6, "pre_dawn"), (6, 8, "dawn"), (8, 12, "morning"), (12, 17, "afternoon"), (17, 20, "evening")]
CLUE_TAGS = ["clue", "discovery", "secret", "player_discovery"]
CAPABILITY_KEYS = ["threat_level", "capabilities", "equipment", "limitations", "escalation_profile"]
DISCOVERY_KEYS = ["knowledge", "cause_of_death", "status", "description"]

# --- Fixed values: action rules ---
META_TARGETS = ["scene", "environment", "area", "surroundings", "room", "self", "player"]
ENVIRONMENT_VERBS = [
    "knock", "bang", "push", "pull", "open", "close", "climb", "jump", "touch", "use", "enter", "exit", "hide",
    "lean", "sit", "stand", "crouch", "run", "move", "go", "walk", "look", "listen", "wait", "yell", "shout",
    "call", "signal", "drop", "throw", "toss", "discard", "sneak", "dodge", "duck", "crawl",
]
ITEM_REQUIREMENTS = [("shoot", "weapon", 1), ("shoot", "ammo", 1), ("unlock", "lockpick", 1), ("pay", "cred", 1)]
INTERACTIVE_VERBS = ["talk", "ask", "speak", "persuade", "intimidate", "bribe", "trade", "give"]
VIOLENT_VERBS = ["attack", "combat", "violence", "shoot"]
MAGIC_VERBS = ["cast", "spell", "magic"]
SAFE_ACTIONS = [
    "look", "examine", "observe", "listen", "wait", "think", "remember", "talk", "ask", "say", "search",
    "investigate", "read", "check", "assess", "use", "take", "grab", "pickup", "drop", "give", "put", "open",
    "close", "move", "go", "enter", "exit", "walk",
]
RISKY_FLAGS = ["violence", "contested", "dangerous", "pursuit", "hostile_present"]
COUNTERS_ENABLED = ["heat", "time", "cred", "harm", "rep"]
DECREMENTING = ["time"]
ACTION_COSTS = [
    ("investigate", "time", 1), ("search", "time", 1), ("talk", "time", 1), ("social", "time", 1),
    ("persuade", "time", 1), ("negotiate", "time", 1), ("travel", "time", 2), ("hack", "heat", 1),
    ("hack", "time", 1), ("steal", "heat", 2), ("steal", "time", 1), ("combat", "heat", 1), ("attack", "heat", 1),
    ("violence", "heat", 1), ("crime", "heat", 2), ("bribe", "cred", 50), ("buy", "cred", 0), ("wait", "time", 1),
]
# listed with no cost at all
FREE_ACTIONS = ["_default", "examine", "move", "go", "sneak", "climb", "use", "look"]
DURATIONS = [
    ("_default", 5), ("look", 1), ("examine", 1), ("use", 2), ("move", 2), ("go", 2), ("sneak", 5), ("climb", 5),
    ("talk", 10), ("ask", 5), ("persuade", 15), ("negotiate", 15), ("intimidate", 5), ("search", 15),
    ("investigate", 20), ("hack", 15), ("travel", 30), ("combat", 5), ("attack", 3), ("steal", 10), ("wait", 15),
    ("read", 5),
]
FAILURE_EFFECTS = [
    ("forgiving", "default", "time", 1), ("consequential", "combat", "harm", 1),
    ("consequential", "default", "heat", 1), ("punishing", "combat", "harm", 2), ("punishing", "combat", "heat", 1),
    ("punishing", "default", "heat", 1),
]
COMPLICATION_EFFECTS = [("combat", "heat", 1), ("default", "time", 1)]
FAILURE_COMBAT_VERBS = ["combat", "attack", "fight", "shoot"]
COMPLICATION_COMBAT_VERBS = ["combat", "attack", "violence"]
TIER2_HARM_VERBS = ["sneak", "hide", "flee", "climb", "fight", "attack", "chase"]
STEALTH_VERBS = ["sneak", "hide", "steal"]
TRUST_UP_VERBS = ["talk", "persuade", "help", "negotiate"]
TRUST_DOWN_VERBS = ["persuade", "intimidate", "deceive", "negotiate", "provoke"]
TRUST_EXEMPT = ["scene", "self", "player"]
CONDITION_OF = [
    ("sneak", "exposed"), ("hide", "exposed"), ("steal", "detected"), ("hack", "detected"), ("flee", "cornered"),
    ("chase", "pursued"), ("climb", "exposed"), ("fight", "injured"), ("attack", "injured"), ("combat", "injured"),
    ("deceive", "detected"),
]
CLEARED_BY = [
    ("exposed", ["hide_success", "flee_success", "scene_change"]),
    ("detected", ["scene_change", "deceive_success"]),
    ("cornered", ["fight_success", "talk_success", "scene_change"]),
    ("injured", ["rest_success", "medical_success"]),
    ("pursued", ["flee_success", "hide_success", "fight_success"]),
]
THREAT_RANK = [("extreme", 4), ("high", 3), ("moderate", 2), ("low", 1)]
COUNTER_KEYWORDS = [("heat", ["heat", "attention"]), ("time", ["time", "deadline"])]
POOL_THRESHOLDS = {"critical": 4, "success": 2, "mixed": 1}
DEFAULT_STATS = ("wits", "alertness")

# --- Fixed values: evaluation ---
DESCRIPTION_WORDS = ["see", "hear", "smell", "feel", "notice", "appear"]
CONSEQUENCE_WORDS = ["but", "however", "unfortunately", "consequence", "result"]

# --- Fixed values: rule-text extraction ---
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will "
    "would could should may might must shall can need dare ought used this that these those it its he she they them "
    "his her their my your our who whom whose which what where when why how all each every both few more most other "
    "some such no nor not only own same so than too very just also now here there then once any many much new old "
    "first last long great little right big high different small large next early young important public bad able "
    "into after before between under again further during about against above below up down out off over through "
    "while because until unless although though however therefore thus hence otherwise still already yet even ever "
    "never always often sometimes usually really quite rather almost enough especially particularly generally "
    "specifically using based following given certain within without whether either neither nothing something "
    "anything everything someone anyone everyone nobody anybody everybody chapter section page table example note see"
).split()
DIFFICULTY_LABELS = "easy|routine|standard|challenging|difficult|hard|very\\s+hard|nearly\\s+impossible|trivial"
PRESET_LABELS = (
    "easy|routine|standard|straightforward|challenging|difficult|hard|very\\s*hard|nearly\\s*impossible|trivial"
)
NUMBER_WORDS = [
    ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8),
    ("nine", 9), ("ten", 10),
]
DEGREE_LABELS = "marginal|moderate|complete|exceptional|phenomenal"
CONDITION_WORDS = [
    "bruised", "hurt", "injured", "wounded", "mauled", "crippled", "incapacitated", "exposed", "hidden", "pursued",
    "cornered", "stunned", "prone", "grappled", "blinded", "deafened", "frightened", "poisoned", "detected", "alert",
    "suspicious", "hostile", "friendly", "paradox", "quiet", "marauder", "nephandi",
]
ACTION_WORDS = [
    "attack", "defend", "dodge", "parry", "block", "grapple", "move", "run", "climb", "jump", "swim", "fly",
    "persuade", "intimidate", "deceive", "negotiate", "seduce", "examine", "search", "investigate", "research",
    "analyze", "sneak", "hide", "steal", "pickpocket", "disguise", "hack", "repair", "craft", "drive", "pilot",
    "cast", "ritual", "effect", "rote",
]
COMMON_ATTRIBUTES = [
    ("physical", ["strength", "dexterity", "stamina", "constitution", "agility", "body"]),
    ("mental", ["intelligence", "wits", "perception", "wisdom", "reason", "mind"]),
    ("social", ["charisma", "manipulation", "appearance", "presence", "composure"]),
]
COST_TRAITS = [
    "attribute", "ability", "skill", "sphere", "discipline", "background", "merit", "willpower", "virtue",
]
NOT_DAMAGE_TYPES = ["no", "the", "any", "all", "some", "more", "less", "take", "deal", "do"]
SCHOOL_PATTERNS = [
    r"sphere\s+of\s+(\w+)", r"(\w+)\s+sphere", r"school\s+of\s+(\w+)", r"(\w+)\s+school",
    r"discipline\s+of\s+(\w+)", r"(\w+)\s+discipline", r"domain\s+of\s+(\w+)", r"(\w+)\s+domain",
]
NOT_SCHOOLS = ["the", "a", "an", "magic"]
RESOURCE_PATTERNS = [
    r"\b(mana|quintessence|essence|power\s*points?|spell\s*points?|arcane\s*points?)\b",
    r"(\w+)\s+pool\s+(?:of|for)\s+(?:magic|casting|spells?)", r"spend\s+(\w+)\s+(?:to|for)\s+(?:cast|magic|spell)",
]
CASTING_STAT_PATTERNS = [
    r"roll\s+(?:your\s+)?(\w+)\s+(?:as\s+)?(?:a\s+)?dice\s*pool",
    r"(\w+)\s+(?:rating|score)\s+(?:determines?|is\s+used\s+for)\s+(?:magic|casting|spells?)",
    r"cast(?:ing)?\s+(?:uses?|requires?)\s+(\w+)", r"(\w+)\s+roll\s+(?:for|to\s+cast)",
]
NOT_CASTING_STATS = ["a", "the", "your", "their", "dice", "d10", "d20"]
CASTING_MECHANICS = [
    (r"dice\s*pool|pool\s+of\s+dice", "dice pool"), (r"d20\s*\+|roll\s+d20", "d20 + modifier vs DC"),
    (r"2d6|pbta|powered\s+by\s+the\s+apocalypse", "2d6 + stat"), (r"spell\s*slots?|prepared\s+spells?", "spell slots"),
]
RESOLUTION_METHODS = [
    (r"dice\s*pool|roll\s+\d+\s+dice|attribute\s*\+\s*ability", "dice_pool"),
    (r"roll\s+2d6|moves?\s+trigger|pbta|powered\s+by", "sum_bands"),
    (r"d20|difficulty\s+class|dc\s+\d+", "target_number"),
]
POOL_PATTERNS = [
    r"(attribute)\s*\+\s*(ability)", r"(stat)\s*\+\s*(skill)", r"(\w+)\s*\+\s*(\w+)\s*(?:dice|pool)",
]
OUTCOME_THRESHOLD_PATTERNS = [
    ("exceptional", r"(\d+)\s*(?:or\s+more\s+)?success(?:es)?.*exceptional"),
    ("success", r"(\d+)[-–](\d+)\s*success(?:es)?.*(?:standard|complete|full)"),
    ("marginal", r"(\d+)\s*success.*(?:marginal|partial|mixed)"),
]
NO_SUCCESS_PATTERN = r"(?:no|zero|0)\s*success(?:es)?.*fail"
ONES_CANCEL_PATTERN = r"1s?\s+cancel|ones?\s+cancel|subtract.*ones?|each\s+1\s+cancels?"
BOTCH_PATTERN = r"botch|critical\s+failure|catastrophic"
WILLPOWER_PATTERN = (
    r"(?:spend|use)\s+(?:a\s+)?(?:point\s+of\s+)?(willpower|wp|will)\s*"
    r"(?:for|to\s+(?:gain|get|add))?\s*(\d+)?\s*(?:automatic\s+)?success"
)
SPECIALTY_PATTERN = r"specialty|specialization|specialities"
AUTO_SUCCESS_PATTERN = (
    r"(?:automatic(?:ally)?|auto)\s+(?:success|succeed).*(?:if|when).*(?:pool|dice)\s*"
    r"(?:>=?|equals?|exceeds?)\s*(?:difficulty|target)"
)
HEALTH_TRACKS = [
    (r"health\s*(?:level|track|box)", "levels"), (r"hit\s*points?|hp\b|damage\s*points?", "hit_points"),
    (r"stress\s*(?:box|track)|condition\s*track", "stress_boxes"),
]
SOAK_PATTERNS = [
    r"\b(soak)\b.*?(?:roll|dice)", r"(?:roll|dice).*?\b(soak)\b", r"\b(resistance)\s+roll",
    r"(?:reduce|absorb)\s+damage.*?(?:roll|dice)",
    r"(?:stamina|constitution|toughness)\s+(?:to\s+)?(?:reduce|absorb|resist)",
]
SOAK_STAT_PATTERN = (
    r"(stamina|constitution|toughness|endurance|fortitude|body)\s+(?:to\s+)?(?:soak|reduce|absorb|resist)"
)
BACKLASH_WORDS = [
    "paradox", "backlash", "miscast", "wild magic", "surge", "corruption", "taint", "feedback", "blowback",
]
NOT_ITEM_WORDS = ["chapter", "section", "table", "equipment", "class", "tier"]
NOT_ITEM_NAMES = [
    "type", "damage", "range", "rate", "clip", "conceal", "weapon", "armor", "health", "track", "penalty", "rating",
    "protection",
]
ARMOUR_TIERS = [
    ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("i", 1), ("ii", 2), ("iii", 3), ("iv", 4),
    ("v", 5), ("1", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 5), ("light", 1), ("medium", 2), ("heavy", 3),
]
# rule_set, pattern, meaning, confidence
RULE_TABLE = [
    ("indicator", r"[●○◯◉]+", "rating_dots", 0.7), ("indicator", r"\|.*\d+.*\|", "table_with_numbers", 0.6),
    ("indicator", r"\b\d*d\d+\b", "dice_notation", 0.8), ("indicator", r"^\d+\.\s+.{10,}", "numbered_list", 0.4),
    ("indicator", r"^[A-Z][a-z]+:\s*\d+", "stat_line", 0.5),
    ("indicator", r"\b(Level|Rank|Tier)\s*\d+", "level_indicator", 0.6),
    ("indicator", r"\(\d+\s*(pts?|points?|xp|cp)\)", "point_cost", 0.7),
    ("indicator", r"\b(DC|TN|Difficulty)\s*\d+", "difficulty_number", 0.8),
    ("indicator", r"[+-]\d+\s*(bonus|penalty|modifier)?", "modifier", 0.5),
    ("section", r"^(Character Creation|Making a Character|Creating Your Character|Step \d+:)$",
     "character_creation", 0.7),
    ("section", r"^(Equipment|Gear|Weapons|Armor|Items)$", "equipment", 0.7),
    ("section", r"^(Combat|Fighting|Conflict|Battle|Action)$", "combat", 0.7),
    ("section", r"^(Magic|Powers|Abilities|Spells|Special Abilities)$", "powers", 0.6),
]
# sections that count for an extractor's rule hits, besides every indicator
EXTRACTOR_SECTIONS = [
    ("stat_schema", "abilities"), ("equipment", "equipment"), ("magic", "spheres"), ("magic", "disciplines"),
    ("magic", "gifts"),
]
KEY_FIELDS = [
    ("resolution", ["method", "die_type", "default_difficulty"]), ("stat_schema", ["attributes", "abilities"]),
    ("health", ["health_levels", "health_track_type"]),
    ("equipment", ["melee_weapons", "ranged_weapons", "armor"]), ("magic", ["magic_system"]),
    ("conditions", ["conditions"]), ("clocks", ["clocks"]), ("calibration", ["presets"]),
    ("action_types", ["action_types"]),
]
