"""Lexicons, rule tables and patterns. Rules are (pattern, replacement,
confidence); \\1 and \\2 in a replacement are groups of the match."""

# --- fixed values: lexicons -------------------------------------------------------------
STARTER_WORDS = "the of and to a in is that for it as with was he on".split()
#: What the word corrector takes for right, with the game terms.
COMMON_WORDS = (
    "the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or an will "
    "my one all would there their what so up out if about who get which go me when make can like time no just him know take "
    "people into year your good some could them see other than then now look only come its over think also back after use "
    "two how our work first well way even new want because any these give day most us"
).split()
GAME_TERMS = (
    "dungeons dragons d&d dnd dm pc npc gm hitpoints hp ac xp proficiency initiative multiclass subclass feat feats "
    "cantrip cantrips spellcasting str dex con int wis cha strength dexterity constitution intelligence wisdom charisma "
    "barbarian bard cleric druid fighter monk paladin ranger rogue sorcerer warlock wizard dwarf dwarves elf elves halfling "
    "human dragonborn gnome tiefling half-elf half-orc aasimar genasi longsword shortsword greatsword greataxe battleaxe "
    "quarterstaff crossbow longbow shortbow warhammer mace dagger rapier shield armor armour potion adventurer adventurers "
    "spellcaster unarmored roleplaying dungeon monster creature alignment skill skills saving save attack damage magic "
    "magical spell spells circumstances circumstance"
).split()
RUN_TOGETHER_WORDS = (
    "the and of to a in for is on that by this with you it not or be are from at as your have more an was we will can do "
    "use one they all their has been would make about if into time only how may its some what when out up no who see get "
    "which go than our know just any take give over think also back after other two these first way well even new want "
    "because most each look day could come both between must"
).split()
SPLITTABLE_WORDS = "and the you your with that this from they have what were when will whom their".split()
CHAPTER_TITLES = "Races Classes Equipment Spells Combat Adventuring Spellcasting".split()
CONJUNCTIONS = "and or but nor for yet so the a an in on at to of with by from".split()
APPENDIX_PHRASES = (
    "index", "appendix", "glossary", "references", "bibliography", "game dice", "character sheet", "creature statistics",
    "inspirational reading", "god", "plane", "multiverse", "advantage", "disadvantage",
)
SUFFICIENCY_MARKERS = ("This PDF does not contain text", "No text content available")
HANGING_WORDS = "and or but the a an in on at to of with".split()
ABILITIES = "Strength Dexterity Constitution Intelligence Wisdom Charisma".split()

# --- fixed values: OCR repairs of the word corrector, in order --------------------------
OCR_REPAIRS = (
    (r"\bm(?:\s*)ore\b", "more"), (r"\bw(?:\s*)ith\b", "with"), (r"\bt(?:\s*)he\b", "the"), (r"\ba(?:\s*)n(?:\s*)d\b", "and"),
    (r"\bf(?:\s*)or\b", "for"), (r"\by(?:\s*)ou(?:\s*)r\b", "your"), (r"\bt(?:\s*)o\b", "to"), (r"\bt(?:\s*)hat\b", "that"),
    (r"\bo(?:\s*)f\b", "of"), (r"\bD(?:\s*)&(?:\s*)D\b", "D&D"),
    (r"\bDun(?:\s*)geo(?:\s*)ns?(?:\s*)&(?:\s*)Dra(?:\s*)go(?:\s*)ns?\b", "Dungeons & Dragons"),
)
HYPHENATION = (r"(\w{2,})\xad\s*\n+\s*(\w{2,})", r"(\w{2,})-\s*\n+\s*(\w{2,})", r"(\w{2,})\s+-\s*(\w{2,})")
COMMON_SPACING = (
    (r"\byou\s+r\b", "your"), (r"\bm\s+ore\b", "more"), (r"\bDoyou\b", "Do you"), (r"\bthe\s+se\b", "these"), (r"\bwhat\s+ever\b", "whatever"),
    (r"\bit's\s*a(\w+)", r"it's a \1"), (r"\bsom\s+e\b", "some"), (r"\bof(\w+)", r"of \1"), (r"\s{2,}", " "),
)

# --- fixed values: lint rules, in order -------------------------------------------------
SPLIT_PRONOUNS = tuple(
    (a, b, 0.95)
    for a, b in ((r"you\s+r\b", "your"), (r"you\s+rs\b", "yours"), (r"o\s+ur\b", "our"), (r"w\s+e\b", "we"), (r"th\s+ey\b", "they"), (r"th\s+em\b", "them"), (r"th\s+eir\b", "their"))
)
SPLIT_TERMS = tuple(
    (a, b, 0.95)
    for a, b in (
        (r"w\s+eapon", "weapon"), (r"ar\s+mor", "armor"), (r"c\s+haracter", "character"), (r"s\s+pell", "spell"), (r"m\s+agic", "magic"),
        (r"a\s+bility", "ability"), (r"s\s+kill", "skill"), (r"c\s+lass", "class"), (r"r\s+ace", "race"),
    )
)
LINE_BREAK = ((r"(\w{2,})-\s*\n\s*(\w{2,})", r"\1\2", 0.9),)
SPACING_RULES = (
    *SPLIT_PRONOUNS,
    *((a, b, 0.95) for a, b in ((r"t\s+he\b", "the"), (r"a\s+nd\b", "and"), (r"o\s+f\b", "of"), (r"i\s+n\b", "in"), (r"o\s+n\b", "on"), (r"a\s+t\b", "at"), (r"b\s+ut\b", "but"), (r"f\s+or\b", "for"))),
    *SPLIT_TERMS,
    *LINE_BREAK,
    *(
        (a, b, 0.95)
        for a, b in (
            (r"som\s+e", "some"), (r"what\s+ever", "whatever"), (r"to\s+o", "too"), (r"with\s+in", "within"), (r"with\s+out", "without"),
            (r"any\s+one", "anyone"), (r"every\s+one", "everyone"), (r"some\s+one", "someone"), (r"no\s+one", "no one"),
        )
    ),
    (r"\b(\w{2})\s+(\w{2,})\b", r"\1\2", 0.85),
)
JOINED_RULES = (
    *(
        (a, b, 0.95)
        for a, b in (
            ("weuse", "we use"), ("youcan", "you can"), ("youhave", "you have"), ("youare", "you are"), ("youmay", "you may"), ("youmust", "you must"),
            ("youmight", "you might"), ("youshould", "you should"), ("youdo", "you do"), ("youget", "you get"), ("it'sa", "it's a"),
            (r"that's(\w+)", r"that's \1"), (r"it's(\w+)", r"it's \1"), (r"there's(\w+)", r"there's \1"),
        )
    ),
)
WORD_JOIN_RULES = (*JOINED_RULES, (r"(\w+)'s(\w+)", r"\1's \2", 0.9))
PHRASE_RULES = (
    (r"characters?\s+sheet", "character's sheet", 0.9), (r"players?\s+handbook", "player's handbook", 0.9),
    (r"dungeon\s+masters?\s+guide", "dungeon master's guide", 0.9), (r"role\s+play", "roleplay", 0.9), (r"skill\s+check", "skill check", 0.9),
    (r"saving\s+throws?", "saving throw", 0.9), (r"hit\s+points?", "hit points", 0.9), ("what ever", "whatever", 0.95), ("which ever", "whichever", 0.95),
    ("how ever", "however", 0.95), ("when ever", "whenever", 0.95), ("where ever", "wherever", 0.95), ("who ever", "whoever", 0.95),
)
SPLIT_WORD_RULES = (
    *SPLIT_TERMS,
    (r"d\s+amage", "damage", 0.95), (r"c\s+reature", "creature", 0.95), (r"a\s+ttack", "attack", 0.95),
    *SPLIT_PRONOUNS,
    *LINE_BREAK,
    *(
        (a, b, 0.95)
        for a, b in (
            (r"som\s+e", "some"), (r"wh\s+at", "what"), (r"th\s+at", "that"), (r"th\s+is", "this"), (r"th\s+an", "than"), (r"wh\s+en", "when"),
            (r"wh\s+ere", "where"), (r"th\s+ere", "there"),
        )
    ),
)
GENERAL_SPLIT = (r"\b(\w{2,})\s+(\w{2,})\b", r"\1\2", 0.85)
NOT_SPLIT_BEFORE = "of on in at by for with to from and or but nor yet so".split()
#: What is no split word although it looks like one.
SPLIT_EXCEPTIONS = (
    r"\d{2,4}\s+\d{2,4}", r"\d+\s+\w+\s+\d+", r"Dungeons\s+Dragons", r"Dungeon\s+Master", r"Players\s+Handbook",
    r"Chapter\s+\d+", r"Table\s+\d+", r"Figure\s+\d+", r"Part\s+\d+", r"Appendix\s+\w+", r"Table\s+of", r"Index\s+of", r"List\s+of",
    r"hit\s+points", r"armor\s+class", r"ability\s+score", r"saving\s+throw", r"spell\s+slot", r"attack\s+roll", r"spell\s+casting",
    r"action\s+economy", r"bonus\s+action", r"damage\s+type", r"damage\s+roll", r"ability\s+check", r"character\s+sheet",
    r"character\s+class", r"character\s+level", r"skill\s+check", r"concentration\s+check",
    r"based\s+on", r"depends\s+on", r"focuses\s+on", r"relies\s+on", r"consists\s+of", r"made\s+of", r"part\s+of", r"type\s+of", r"kind\s+of",
    r"sort\s+of", r"bunch\s+of", r"group\s+of", r"set\s+of", r"lot\s+of", r"full\s+of", r"capable\s+of",
    r"Table\s+of\s+Contents", r"Extracted\s+on", r"Created\s+by", r"Written\s+by", r"Edited\s+by", r"Published\s+by", r"Illustrated\s+by",
)

# --- fixed values: chapter and table patterns -------------------------------------------
SPACED_TEXT = (r"^C\s+h\s+a\s+p\s+t\s+e\s+r\s+\d+", r"^[A-Z](\s+[a-z])+$", r"^([A-Z](\s+[a-z])+\s+)+[A-Z](\s+[a-z])+$")
STEP_BY_STEP = r"st\s*[e\s]*p\s*[b\s]*y\s*[s\s]*t\s*e\s*p\s*characters"
TOC_TAILS = (r"\.\.\.\.\.*\d+$", r"\s\d+$")
COLUMN_CLASSES = {
    "level": r"^\d{1,2}(?:st|nd|rd|th)?$", "number": r"^[+-]?\d+$", "modifier": r"^[+-]\d+$", "feature": r"^[A-Z][a-zA-Z\s,]+$",
    "class_name": r"^[A-Z][a-zA-Z]+$", "hit_die": r"^d\d+$",
    "ability": "^(?:" + "|".join(ABILITIES) + r")(?:\s*(?:&|\+)\s*(?:" + "|".join(ABILITIES) + "))?$",
}
TABLE_TYPES = {"class_table": ("class_name", "hit_die", "ability"), "level_progression": ("level", "modifier", "feature")}
TABLE_COLUMNS = {
    "class_table": ("Class", "Description", "Hit Die", "Primary Ability", "Saving Throws", "Proficiencies"),
    "level_progression": ("Level", "Proficiency Bonus", "Features", "Rages", "Rage Damage"),
}
