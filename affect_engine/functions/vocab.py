"""Word lists and tables the text and label operators share.

Fixed values: these must be exactly these for results to be right, so they are
stated here as plain tables and nowhere else.
"""

from __future__ import annotations

# The label space.
EMOTION_CLASSES = ("anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise")

EMOTION_ALIASES = {
    "happiness": "joy",
    "happy": "joy",
    "enthusiasm": "joy",
    "sad": "sadness",
}

EMOTION_DISPLAY = {
    "anger": "Anger",
    "disgust": "Disgust",
    "fear": "Fear",
    "joy": "Happiness",
    "neutral": "Neutral",
    "sadness": "Sadness",
    "surprise": "Surprise",
}

# Label ids on a drawn timeline.
TIMELINE_ORDER = ("neutral", "joy", "fear", "anger", "surprise", "sadness", "disgust")

# Collapse order; Joy wins only when nothing else is present.
LABEL_PRIORITY = ("disgust", "neutral", "fear", "sadness", "surprise", "anger", "joy")

# Stages in execution order.
STAGE_IDS = ("1", "2", "3", "4", "5A", "5B", "6A", "6B", "7A", "7B", "8", "9")

# Transcript model preference, best first.
TRANSCRIPT_MODEL_RANK = {
    "large-v3": 5,
    "large": 4,
    "medium": 3,
    "small": 2,
    "base": 1,
    "tiny": 0,
}

# Confidence gates of the sweep.
CONFIDENCE_GATES = (0.25, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95)

# Characters and their plain spelling.
QUOTES = {
    "‘": "'",
    "’": "'",
    "‚": "'",
    "‹": "'",
    "›": "'",
    "`": "'",
    "“": '"',
    "”": '"',
    "„": '"',
    "«": '"',
    "»": '"',
    "–": "-",
    "—": "-",
    "−": "-",
}

# Canonical placeholder and its spellings.
PLACEHOLDERS: dict[str, tuple[str, ...]] = {
    "NAME": ("NAME", "ИМЕНИ"),
    "RELIGION": ("RELIGION", "РЕЛИГИЯ"),
    "CITY": ("CITY", "ГОРОД"),
    "LOCATION": ("LOCATION", "МЕСТО"),
    "COUNTRY": ("COUNTRY", "СТРАНА"),
    "ORGANIZATION": ("ORGANIZATION", "ORG"),
    "URL": ("URL",),
    "TAG": ("TAG", "TEG"),
    "NUM": ("NUM", "NUMBER"),
}

# Entity words.
NAMES = (
    "Trump",
    "Biden",
    "Obama",
    "Clinton",
    "Bush",
    "Putin",
    "Xi",
    "Donald",
    "Joe",
    "Barack",
    "Hillary",
    "George",
    "John",
    "Michael",
    "David",
    "James",
    "Robert",
    "William",
    "Mary",
    "Jennifer",
    "Linda",
    "Elizabeth",
    "Jessica",
)
RELIGIONS = (
    "Christianity",
    "Islam",
    "Judaism",
    "Buddhism",
    "Hinduism",
    "Catholic",
    "Orthodox",
    "Protestant",
    "Muslim",
    "Christian",
    "Jewish",
    "Buddhist",
    "Hindu",
    "atheist",
    "agnostic",
)
CITIES = (
    "New York",
    "Los Angeles",
    "Chicago",
    "Houston",
    "Phoenix",
    "London",
    "Paris",
    "Berlin",
    "Moscow",
    "Tokyo",
    "Beijing",
    "Mumbai",
    "Dubai",
    "Singapore",
    "Sydney",
    "Toronto",
)

# Shorthand and its expansion.
SLANG: dict[str, str] = {
    "lol": "laughing out loud",
    "lmao": "laughing my ass off",
    "rofl": "rolling on floor laughing",
    "omg": "oh my god",
    "wtf": "what the fuck",
    "wth": "what the hell",
    "ffs": "for fuck sake",
    "smh": "shaking my head",
    "tbh": "to be honest",
    "imo": "in my opinion",
    "imho": "in my humble opinion",
    "afaik": "as far as i know",
    "iirc": "if i recall correctly",
    "btw": "by the way",
    "fyi": "for your information",
    "ftw": "for the win",
    "idk": "i do not know",
    "idc": "i do not care",
    "jk": "just kidding",
    "lmk": "let me know",
    "nvm": "never mind",
    "asap": "as soon as possible",
    "brb": "be right back",
    "gtg": "got to go",
    "g2g": "got to go",
    "ttyl": "talk to you later",
    "tmi": "too much information",
    "irl": "in real life",
    "rip": "rest in peace",
    "til": "today i learned",
    "nsfw": "not safe for work",
    "tldr": "too long did not read",
    "tl;dr": "too long did not read",
    "ama": "ask me anything",
    "dae": "does anyone else",
    "yolo": "you only live once",
    "fomo": "fear of missing out",
    "u": "you",
    "ur": "your",
    "r": "are",
    "y": "why",
    "bc": "because",
    "bcuz": "because",
    "cuz": "because",
    "cos": "because",
    "b4": "before",
    "gr8": "great",
    "l8r": "later",
    "m8": "mate",
    "h8": "hate",
    "w8": "wait",
    "ppl": "people",
    "plz": "please",
    "pls": "please",
    "thx": "thanks",
    "tks": "thanks",
    "ty": "thank you",
    "tysm": "thank you so much",
    "np": "no problem",
    "yw": "you are welcome",
    "ya": "you",
    "yea": "yes",
    "yeah": "yes",
    "nah": "no",
    "nope": "no",
    "yup": "yes",
    "yep": "yes",
    "gonna": "going to",
    "wanna": "want to",
    "gotta": "got to",
    "gimme": "give me",
    "lemme": "let me",
    "kinda": "kind of",
    "sorta": "sort of",
    "dunno": "do not know",
    "shoulda": "should have",
    "woulda": "would have",
    "coulda": "could have",
    "shouldve": "should have",
    "wouldve": "would have",
    "couldve": "could have",
    "ikr": "i know right",
    "ik": "i know",
    "fr": "for real",
    "ngl": "not gonna lie",
    "tho": "though",
    "prolly": "probably",
    "obv": "obviously",
    "def": "definitely",
    "probs": "probably",
    "srsly": "seriously",
    "sry": "sorry",
    "mb": "my bad",
    "rn": "right now",
    "atm": "at the moment",
    "eta": "estimated time of arrival",
    "24/7": "twenty four seven",
    "dm": "direct message",
    "pm": "private message",
    "rt": "retweet",
    "fb": "facebook",
    "ig": "instagram",
    "yt": "youtube",
    "sub": "subscribe",
    "unsub": "unsubscribe",
    "fav": "favorite",
    "fave": "favorite",
    "af": "as fuck",
    "asf": "as fuck",
    "bae": "babe",
    "bff": "best friends forever",
    "bf": "boyfriend",
    "gf": "girlfriend",
    "gg": "good game",
    "wp": "well played",
    "gl": "good luck",
    "hf": "have fun",
    "gj": "good job",
    "nm": "nothing much",
    "sup": "what is up",
    "wassup": "what is up",
    "whatup": "what is up",
    "amirite": "am i right",
    "abt": "about",
    "abo": "about",
    "w/": "with",
    "w/o": "without",
    "b/c": "because",
    "op": "overpowered",
    "ftfy": "fixed that for you",
    "oc": "original content",
    "goat": "greatest of all time",
    "bday": "birthday",
    "congrats": "congratulations",
    "pic": "picture",
    "pics": "pictures",
    "vid": "video",
    "vids": "videos",
    "msg": "message",
    "msgs": "messages",
    "aka": "also known as",
    "etc": "et cetera",
    "vs": "versus",
    "thru": "through",
    "approx": "approximately",
    "min": "minute",
    "mins": "minutes",
    "sec": "second",
    "secs": "seconds",
    "hr": "hour",
    "hrs": "hours",
    "wk": "week",
    "wks": "weeks",
    "yr": "year",
    "yrs": "years",
    "mo": "month",
    "mos": "months",
    "afk": "away from keyboard",
    "ez": "easy",
    "noob": "newbie",
    "n00b": "newbie",
    "pwn": "own",
    "rekt": "wrecked",
    "kek": "lol",
    "txt": "text",
    "cya": "see you",
    "l8": "late",
    "2day": "today",
    "2nite": "tonight",
    "2moro": "tomorrow",
    "2mrw": "tomorrow",
    "tmr": "tomorrow",
    "tmrw": "tomorrow",
    "tdy": "today",
    "yday": "yesterday",
    "yest": "yesterday",
}

# Words the overlap similarity ignores.
OVERLAP_STOPWORDS = (
    "и",
    "в",
    "на",
    "с",
    "по",
    "для",
    "от",
    "к",
    "у",
    "о",
    "об",
    "а",
    "но",
    "да",
    "или",
    "то",
    "что",
    "как",
    "это",
    "весь",
    "он",
    "она",
    "они",
    "его",
    "её",
    "их",
    "мы",
    "вы",
    "ты",
    "я",
    "меня",
    "мне",
    "тебя",
    "вас",
    "нас",
    "не",
    "ни",
    "уже",
    "еще",
    "так",
    "вот",
    "здесь",
    "там",
    "тут",
    "тоже",
    "также",
    "же",
    "ли",
    "бы",
    "только",
    "был",
    "была",
    "было",
    "были",
    "есть",
    "быть",
    "будет",
    "будут",
    "буду",
    "будешь",
)

# Cyrillic letters that look Latin.
HOMOGLYPHS = {
    "а": "a",
    "А": "A",
    "е": "e",
    "Е": "E",
    "о": "o",
    "О": "O",
    "р": "p",
    "Р": "P",
    "с": "c",
    "С": "C",
    "у": "y",
    "У": "Y",
    "х": "x",
    "Х": "X",
    "і": "i",
    "І": "I",
    "м": "m",
    "М": "M",
    "в": "v",
    "В": "V",
    "к": "k",
    "К": "K",
    "н": "h",
    "Н": "H",
    "т": "t",
    "Т": "T",
}

# Symbols spelled out in parallel text.
SYMBOL_NAMES = {
    "α": "alpha",
    "β": "beta",
    "γ": "gamma",
    "δ": "delta",
    "θ": "theta",
    "λ": "lambda",
    "μ": "mu",
    "π": "pi",
    "≤": "<=",
    "≥": ">=",
    "≠": "!=",
    "±": "+/-",
    "×": "x",
    "÷": "/",
    "²": "2",
    "³": "3",
    "°": " deg ",
}
