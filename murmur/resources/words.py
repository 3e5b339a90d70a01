"""Word tables used by the table-driven operators.

Fixed values: everything in this module is a hand-written constant (no model
weights).  The lists are small on purpose; every operator that uses them also
accepts a user-supplied table of the same shape.
"""

# --- fixed values: English stopwords used by the token keep-rule -----------
STOPWORDS_EN = """
a about above after again against all almost along already also although always am among an and
another any anyone anything are around as at be became because become been before being below
between both but by can cannot could did do does doing done down during each either else enough
even ever every few for from further get had has have having he her here hers herself him himself
his how however i if in into is it its itself just least less many may me might mine more most
much must my myself neither never no nobody none nor not nothing now of off often on once one only
or other others our ours ourselves out over own per perhaps please quite rather really same she
should since so some something still such than that the their theirs them themselves then there
these they this those though through thus to too toward under until up upon us very via was we
well were what whatever when where whether which while who whom whose why will with within without
would yet you your yours yourself yourselves
""".split()

# --- fixed values: security tokens always kept, matched on the whole token ---
SECURITY_KEEP_PATTERN = (
    r"cve-\d{4}-\d+|xss|csrf|sqli|sql|2fa|mfa|c2|sha-\d+|md5|dns|http|https|tcp|udp|ip|vpn|api"
    r"|rce|dos|ddos|user_mention|multi_exclamation|multi_question"
)

# --- fixed values: lemma pairs (surface form, lemma) --------------------------
LEMMA_PAIRS = [
    ("attacks", "attack"), ("attacked", "attack"), ("attacking", "attack"),
    ("attackers", "attacker"), ("hackers", "hacker"), ("hacked", "hack"), ("hacking", "hack"),
    ("hacks", "hack"), ("vulnerabilities", "vulnerability"), ("exploits", "exploit"),
    ("exploited", "exploit"), ("exploiting", "exploit"), ("passwords", "password"),
    ("users", "user"), ("servers", "server"), ("networks", "network"), ("devices", "device"),
    ("systems", "system"), ("threats", "threat"), ("breaches", "breach"), ("breached", "breach"),
    ("leaked", "leak"), ("leaks", "leak"), ("patches", "patch"), ("patched", "patch"),
    ("updates", "update"), ("updated", "update"), ("videos", "video"), ("comments", "comment"),
    ("tutorials", "tutorial"), ("courses", "course"), ("certifications", "certification"),
    ("jobs", "job"), ("companies", "company"), ("countries", "country"), ("tools", "tool"),
    ("files", "file"), ("accounts", "account"), ("emails", "email"), ("links", "link"),
    ("scams", "scam"), ("scammers", "scammer"), ("phones", "phone"), ("apps", "app"),
    ("keys", "key"), ("people", "person"), ("children", "child"), ("men", "man"),
    ("women", "woman"), ("went", "go"), ("goes", "go"), ("going", "go"), ("gone", "go"),
    ("made", "make"), ("makes", "make"), ("making", "make"), ("took", "take"), ("taken", "take"),
    ("takes", "take"), ("taking", "take"), ("got", "get"), ("gets", "get"), ("getting", "get"),
    ("thought", "think"), ("thinks", "think"), ("thinking", "think"), ("knew", "know"),
    ("known", "know"), ("knows", "know"), ("learned", "learn"), ("learning", "learn"),
    ("learns", "learn"), ("saw", "see"), ("seen", "see"), ("sees", "see"), ("said", "say"),
    ("says", "say"), ("told", "tell"), ("found", "find"), ("finds", "find"), ("used", "use"),
    ("uses", "use"), ("using", "use"), ("wrote", "write"), ("written", "write"),
    ("writes", "write"), ("better", "good"), ("best", "good"), ("worse", "bad"), ("worst", "bad"),
    ("loved", "love"), ("loves", "love"), ("liked", "like"), ("likes", "like"),
]

# --- fixed values: language profiles (frequent function words per language) ---
LANGUAGE_PROFILES = {
    "en": "the and of to is in that it was for with as on by this are from be at or an have not "
          "which they but had were has their".split(),
    "fr": "le la les des du et est une un dans que qui pour pas sur au aux avec ce il elle "
          "sont par ou mais nous vous".split(),
    "de": "der die das und ist nicht ein eine zu den mit sich des auf dem von im für "
          "auch es sie ich wir zum zur".split(),
    "es": "el los las del y es en que un una por con para se su al lo como pero más "
          "sus le ya muy fue son".split(),
}

# --- fixed values: polarity lexicon (word, weight) ---------------------------
POLARITY = [
    ("good", 1.0), ("great", 1.5), ("excellent", 2.0), ("amazing", 2.0), ("awesome", 2.0),
    ("love", 1.5), ("like", 0.5), ("best", 1.5), ("helpful", 1.0), ("useful", 1.0),
    ("thanks", 1.0), ("thank", 1.0), ("nice", 1.0), ("clear", 0.5), ("informative", 1.0),
    ("secure", 0.5), ("safe", 0.5), ("perfect", 2.0), ("brilliant", 2.0), ("fantastic", 2.0),
    ("happy", 1.5), ("glad", 1.0), ("easy", 0.5), ("fixed", 0.5), ("protect", 0.5),
    ("recommend", 1.0), ("wonderful", 2.0), ("cool", 1.0), ("interesting", 1.0), ("well", 0.5),
    ("bad", -1.0), ("terrible", -2.0), ("awful", -2.0), ("horrible", -2.0), ("hate", -1.5),
    ("worst", -2.0), ("worse", -1.5), ("useless", -1.5), ("wrong", -1.0), ("boring", -1.0),
    ("scam", -1.5), ("fake", -1.5), ("attack", -0.5), ("breach", -1.0), ("leak", -1.0),
    ("hacked", -1.0), ("stolen", -1.5), ("malware", -1.0), ("ransomware", -1.5), ("virus", -1.0),
    ("broken", -1.0), ("fail", -1.0), ("failed", -1.0), ("problem", -0.5), ("issue", -0.5),
    ("worthless", -2.0), ("angry", -1.5), ("sad", -1.0), ("poor", -1.0), ("annoying", -1.0),
    ("dangerous", -1.0), ("vulnerable", -0.5), ("insecure", -1.0), ("confusing", -1.0),
]

# --- fixed values: emotion lexicon; labels anger, joy, optimism, sadness -----
EMOTION_WORDS = {
    "anger": "angry hate furious rage mad annoying annoyed stupid scam fake ridiculous outrage "
             "worthless disgusting".split(),
    "joy": "happy love great awesome amazing fun glad funny excellent enjoy enjoyed "
           "fantastic wonderful laugh".split(),
    "optimism": "hope hopefully better improve future learn soon will confident "
                "opportunity promising forward grow".split(),
    "sadness": "sad sorry lost miss unfortunately cry depressing disappointed "
               "disappointing alone hurt pain fail failed".split(),
}

# --- fixed values: irony cue words -------------------------------------------
IRONY_CUES = ("yeah right sure totally obviously clearly wow great genius brilliant "
              "lol lmao congrats bravo").split()

# --- fixed values: emoji and their English names ------------------------------
EMOJI_NAMES = [
    ("\U0001F44D", ":thumbs_up:"), ("\U0001F44E", ":thumbs_down:"),
    ("\U0001F602", ":face_with_tears_of_joy:"), ("\U0001F923", ":rolling_on_the_floor_laughing:"),
    ("\U0001F60A", ":smiling_face_with_smiling_eyes:"), ("\U0001F600", ":grinning_face:"),
    ("\U0001F603", ":grinning_face_with_big_eyes:"), ("\U0001F604", ":grinning_face_with_smiling_eyes:"),
    ("\U0001F60D", ":smiling_face_with_heart-eyes:"), ("\U0001F622", ":crying_face:"),
    ("\U0001F62D", ":loudly_crying_face:"), ("\U0001F621", ":enraged_face:"),
    ("\U0001F620", ":angry_face:"), ("\U0001F914", ":thinking_face:"),
    ("\U0001F644", ":face_with_rolling_eyes:"), ("\U0001F631", ":face_screaming_in_fear:"),
    ("\U0001F525", ":fire:"), ("\U0001F4AF", ":hundred_points:"), ("\U0001F64F", ":folded_hands:"),
    ("\U0001F44F", ":clapping_hands:"), ("\U0001F4AA", ":flexed_biceps:"), ("\U0001F480", ":skull:"),
    ("\U0001F512", ":locked:"), ("\U0001F513", ":unlocked:"), ("\U0001F511", ":key:"),
    ("\U0001F4BB", ":laptop:"), ("\U0001F6A8", ":police_car_light:"), ("\U0001F41B", ":bug:"),
    ("\U0001F389", ":party_popper:"), ("\U0001F680", ":rocket:"), ("\U0001F440", ":eyes:"),
    ("\U0001F60E", ":smiling_face_with_sunglasses:"), ("\U0001F609", ":winking_face:"),
    ("\U0001F642", ":slightly_smiling_face:"), ("\U0001F643", ":upside-down_face:"),
    ("❤️", ":red_heart:"), ("❤", ":red_heart:"), ("✅", ":check_mark_button:"),
    ("❌", ":cross_mark:"), ("⚠️", ":warning:"), ("⚠", ":warning:"),
    ("⭐", ":star:"), ("\U0001F44D\U0001F3FB", ":thumbs_up_light_skin_tone:"),
    ("\U0001F44D\U0001F3FD", ":thumbs_up_medium_skin_tone:"),
    ("\U0001F1FA\U0001F1F8", ":United_States:"), ("\U0001F1EC\U0001F1E7", ":United_Kingdom:"),
]

# --- fixed values: gazetteer of named entities (phrase, label) ----------------
GAZETTEER = [
    ("microsoft", "ORG"), ("google", "ORG"), ("apple", "ORG"), ("amazon", "ORG"),
    ("cisco", "ORG"), ("fortinet", "ORG"), ("crowdstrike", "ORG"), ("mandiant", "ORG"),
    ("kaspersky", "ORG"), ("nsa", "ORG"), ("fbi", "ORG"), ("cisa", "ORG"), ("nist", "ORG"),
    ("owasp", "ORG"), ("comptia", "ORG"), ("lockbit", "ORG"), ("lazarus group", "ORG"),
    ("anonymous", "ORG"), ("github", "ORG"),
    ("windows", "PRODUCT"), ("linux", "PRODUCT"), ("kali linux", "PRODUCT"), ("android", "PRODUCT"),
    ("iphone", "PRODUCT"), ("wireshark", "PRODUCT"), ("metasploit", "PRODUCT"), ("nmap", "PRODUCT"),
    ("burp suite", "PRODUCT"), ("chatgpt", "PRODUCT"), ("active directory", "PRODUCT"),
    ("log4j", "PRODUCT"), ("wannacry", "PRODUCT"), ("stuxnet", "PRODUCT"),
    ("china", "GPE"), ("russia", "GPE"), ("north korea", "GPE"), ("iran", "GPE"),
    ("united states", "GPE"), ("india", "GPE"), ("germany", "GPE"), ("france", "GPE"),
    ("ukraine", "GPE"), ("europe", "LOC"), ("silicon valley", "LOC"),
    ("monday", "DATE"), ("tuesday", "DATE"), ("wednesday", "DATE"), ("thursday", "DATE"),
    ("friday", "DATE"), ("saturday", "DATE"), ("sunday", "DATE"), ("today", "DATE"),
    ("yesterday", "DATE"), ("tomorrow", "DATE"),
]

# --- fixed values: question routes and the keywords that select them ----------
# Checked in this order; the first route whose pattern matches wins, anything
# else is answered from evidence (rag_agent).
ROUTE_RULES = [
    ("evaluation_agent", r"evaluat|hallucinat|quality|accuracy|error rate|faithful|mistake"),
    ("summary_agent", r"summar|overview|overall|in short|recap|main points"),
    ("metadata_agent", r"filter|how many|count|number of|likes|video|between|dated|per day"),
    ("sentiment_agent", r"sentiment|positive|negative|neutral|feel|reaction|opinion|mood"),
    ("topic_agent", r"topic|theme|cluster|discuss|talk about|subjects"),
]
VALID_ROUTES = ["sentiment_agent", "topic_agent", "rag_agent", "summary_agent",
                "metadata_agent", "evaluation_agent"]

# --- fixed values: parts of the phrases of the shipped security lexicon ------------
SECURITY_OBJECTS = ["account", "api", "app", "browser", "card", "cloud", "code", "data", "database", "device", "dns",
                    "domain", "email", "endpoint", "identity", "mobile", "network", "password", "server", "website"]
SECURITY_PHRASE_HEADS = ["abuse", "attack", "breach", "compromise", "disclosure", "exposure", "fraud", "hijacking",
                         "leak", "scam", "scanning", "security", "spoofing", "theft", "vulnerability"]
