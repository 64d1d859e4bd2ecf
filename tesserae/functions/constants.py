"""Word lists, patterns and defaults that results depend on."""

STOP = "the and for with from who how why what when their its our are was were been being have has had other else into about than then them".split()
CONNECTORS = "of and the for to in a an on with without against beyond between under over or from up down out its his her their".split()
CANDIDATE_STOP = "with and the of for in on a an to from his her their our your my it its is are was were that this these those but or as at by be we you he she they i not no".split()
BOOK_WORDS = "book books memoir essay writes wrote writing author read reading published publication chapter title titled called edition press argues says said footnote bibliography cite cites monograph".split()
PLACES = [
    "new york", "new york city", "london", "paris", "berlin", "chicago", "boston", "los angeles", "san francisco", "washington", "united states",
    "united kingdom", "great britain", "europe", "america", "africa", "asia", "china", "india", "japan", "russia", "germany", "france", "spain",
    "italy", "canada", "australia", "brazil", "mexico", "california", "texas", "virginia", "harlem", "brooklyn", "manhattan", "oxford", "cambridge",
    "princeton", "yale", "harvard", "stanford", "the west", "the south",
]
REGION = r"(?i)^(north|south|east|west|central|sub-?saharan|south(?:east|west)|north(?:east|west)|middle|near|far|greater|lower|upper|new|old|latin)\s+(africa(n|ns)?|asia(n|ns)?|europe(an|ans)?|america(n|ns)?|india|indies|china|japan|east|world|hemisphere)\b"
DEMOGRAPHIC = r"(?i)^(african|black|white|asian|native|european|latin|jewish|muslim|christian|immigrant|urban|rural|poor|young|old|hispanic)\s+(americans?|africans?|asians?|europeans?|people|men|women|children|students|youth|families|workers|voters)\b"
INSTITUTION_TAIL = ["university", "college", "school", "institute", "institute of", "hospital", "foundation", "corporation", "company", "society", "academy", "museum", "department", "ministry", "bank"]
FIRST_NAMES = "john tony samuel charles thomas daniel william frank ernest anthony richard david james robert michael george edward paul peter mary elizabeth sarah stephen steven barack yuval noah malcolm".split()
AUTHORS = "murray coates dennett obama sowell wilson harari darwin pfaff mcwhorter dawkins burgess buchan benn butler brinkley".split()
CORE_VOCABULARY = """
the of and a an in on for to with without from by at or as is are was were be been not no my his her their our your its it lost losing loss
ground race war peace power pathos hope testament wealth poverty politics locked origin species nature mind body self sapiens victims
conversations reality facing great awakening american americans african history brief humankind murray coates dennett obama sowell wilson
harari book books years year trouble eight we between world me picture dorian gray late admissions quick dead black white new old good evil
beyond moral ethics ethic psychology philosophy philosophical economics capital capitalism democracy freedom liberty justice law order chaos
god religion science scientific evolution genetics intelligence iq brain conscious consciousness language thought thinking fast slow noise
signal theory practice art arts way ways life lives living death dying time times age ages century centuries worlds earth water fire air
blood bone bones skin eye eyes hand hands head heart
""".split()
GLYPH_PAIRS = ["CG", "GB", "BR", "AR", "YI", "UV", "IL", "UL", "OQ", "DO", "FE", "MN", "SZ"]
JUNK_AUTHOR = r"(?i)phone number|database|catalog|list|directory|index"
ARTICLE_MARK = r"(?i)[\"“”]|journal|proceedings|proc\.|nature|science|psychology|behaviour|behavior|entropy|genetics|ssrn|vol\.|no\."
ENTRY_START = r"^[A-Z][a-zA-Z'’-]+,"
YEAR = r"(1[6-9]\d{2}|20\d{2})"
RUN = r"(?U)\b([A-Z][\w'’-]*(?:\s+(?:[A-Z][\w'’-]*|" + "|".join(sorted(CONNECTORS)) + r")){1,6})"
_TITLE = r"((?:[A-Z][\w'’-]*)(?:\s+(?:[A-Z][\w'’-]*|of|and|the|a|for|to|in)){0,5})"
CUE = r"(?U)\b(?:in|reading|finished|finished reading|his|her|their|the|a)?\s*(?:book|books|memoir|essay collection)\s+(?:called|titled|by|named)?\s*" + _TITLE
CUE_VERB = r"(?U)\b(?:writes|wrote|argues in|says in|author of|title of)\s+" + _TITLE
RULE_RANK = {"exact": 0, "prefix": 1, "fuzzy": 2}
#: Share of a node's worth in the exploration tree, by id.
IMPACT = {
    "r17-corroborate": 0.23, "r17-selector": 0.30, "r17-compound": 0.20, "r17-authorpop": 0.20, "r16-fix1": 0.35, "r16-fix2": 0.20, "r16-demo": 0.15,
    "r14-scorer2": 0.11, "r9-budget": 0.11, "r8-group": 0.46, "r8-synth": 0.79, "r14-silence": 0.90, "r11-weak": 0.90, "r5-xref-veto": 0.25,
    "r8-spineonly": 0.40, "r12-deno": 0.70, "r13-captions": 0.30, "r10-degarble": 0.05, "r13-llmfix": 0.30, "r14-manual-llm": 0.11, "o-heldout": 0.45,
    "o-vertical": 0.25, "o-catalog": 0.35, "o-llmkey": 0.20, "o-asr": 0.20,
}
