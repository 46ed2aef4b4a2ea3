"""Words, patterns and weights that results depend on."""

# Stop words of the keyword arm.
STOP_WORDS = """a an the is it in of to and or for on at by be do if as so we he me my no not but are was has had how who what when that this with
from have will can all its they them been does did just more also very about would could should which there their than then some into use using
used i you your""".split()

# Words that mark a broad question.
BROAD_WORDS = """all every everything list history historical ever always usually often tend tends summary summarize overview across compare
comparison pattern patterns recurring general generally multiple various themes examples instances""".split()

# Patterns of question intents, and what takes a question out again.
BROAD = r"\b(?:" + "|".join(BROAD_WORDS) + r")\b"
COUNT = r"\bhow many\b|\bnumber of\b|\bhow much\b|\bcount of\b|\btotal (?:number|count)\b"
COUNT_NOT = r"\bhow many (?:days?|weeks?|months?|years?|hours?|minutes?|times)\b"
CURRENT = r"\b(?:current|currently|latest|most recent|now|nowadays|presently|these days|right now|at present|still)\b|\bas of (?:now|today)\b"
AGGREGATE = (
    r"\bin total\b|\bhow often\b|\bacross (?:all|the|my|every|both)\b|\bthroughout\b|\bevery time\b|\blist all\b|\ball (?:the|my) \w+s\b"
    r"|\b(?:over|in|during) the (?:past|last) (?:year|month|week|day|few|couple)|\bwhich \w+s\b.*\bdid i\b"
)
AGGREGATE_NOT = r"\b(?:how many|how often)\b.*\b(?:a|per)\s+(?:week|day|month|year|night|hour)\b|\bhow many (?:days?|weeks?|months?|years?|hours?|minutes?)\b.*\bbetween\b"

# Patterns of the recall triage, in the order of their decisions.
NEEDS_MEMORY = r"\b(?:previous|earlier|last time|remember|memory|recall|continue|handoff|roadmap|borrow|next|repo|worktree|commit|push|run|test|fix|implement|change|file|path|bug|error|failure|why|how)\b"
ACKNOWLEDGED = r"^(?:ok|okay|k|thanks|thank you|ty|cool|great|nice|sounds good|got it|makes sense|perfect|excellent|awesome|👍|yes|no)[.!?\s]*$"
ASKS_TIME = r"\b(?:what(?:'| i)?s|what is|tell me)\s+(?:the\s+)?(?:current\s+)?(?:time|date)\b|\bcurrent\s+(?:time|date)\b"
SELF_CONTAINED = r"\b(?:translate|rewrite|rephrase|summari[sz]e|format)\b"

# Error patterns in order, and what normalizing replaces.
ERRORS = ["Error:", "TypeError:", "ReferenceError:", "SyntaxError:", "AssertionError:", "failed", "ENOENT", "EACCES", "Cannot find module", "Cannot read properties", "Uncaught", "Exception"]
ERROR_PARTS = [(r":\d+:\d+", ":LINE:COL"), (r"/[\w\-/]+/", "/PATH/"), (r"0x[0-9a-f]+", "0xADDR"), (r"\d{10,}", "NUM")]

# Path-like references in text.
FILE_REF = r"(?:(?:/[\w.@+-][\w.@+/-]*[\w.@+-])|(?:[\w.@+-]+/)+[\w.@+-]+)(?::\d+)?"

# Function words and negations of claims.
CLAIM_STOP = """a an the this that these those i you he she it we they me him her us them my your his its our their is am are was were be been being
do does did has have had of to in on at for and or but with as by from into""".split()
NEGATIONS = "not no never none without cannot cant nor".split()

# Trust weights.
SOURCE_WEIGHTS = {"agreed_upon": 1.30, "user_stated": 1.20, "agent_suggested": 0.85, "external": 0.75, "llm_extracted": 0.70, "hook_auto_learned": 0.60}
ORIGIN_WEIGHTS = {"user": 1.15, "cli": 1.10, "store": 1.00, "external": 0.85, "codex_extract": 0.80, "transcript_extract": 0.75, "hook": 0.65}
TYPE_WEIGHTS = {"DECISION": 1.08, "PREFERENCE": 1.08, "GOTCHA": 1.04, "WORKING_SOLUTION": 1.02, "PATTERN": 1.00, "FAILURE": 1.00}

# Predicates that exclude each other.
ANTONYMS = [("uses", "does_not_use"), ("prefers", "avoids"), ("fixes", "breaks")]

# By memory type, patterns whose first match makes a triple.
SOLUTION = [r"(?:use|run|try)\s+(.+?)\s+(?:to|for)\s+(.+)", r"(.+?)\s+(?:fixes|solves|resolves)\s+(.+)", r"(.+?)\s+(?:works|worked)\s+(?:for|with)\s+(.+)"]
GOTCHA = [r"(.+?)\s+(?:causes|breaks|blocks)\s+(.+)", r"(?:watch out|beware|careful)(?:\s+(?:for|of|with))?\s+(.+)", r"(?:don'?t|avoid|never)\s+(.+)"]
FOLLOWS = [r"(.+?)\s+(?:uses|follows|adopts)\s+(.+)", r"(.+?)\s+(?:pattern|convention|approach):\s*(.+)"]
DECISION = [r"(?:chose|decided|picked|selected)\s+(.+?)(?:\s+over\s+(.+))?$", r"(?:using|use|prefer)\s+(.+?)(?:\s+(?:for|because)\s+(.+))?$"]
FAILURE = [r"(.+?)\s+(?:doesn'?t work|fails?|broke)\s*(?:for|with|because)?\s*(.*)", r"(.+?)\s+(?:is broken|is incompatible)\s*(?:with)?\s*(.*)"]
PREFERENCE = [r"(?:prefer|prefers|likes?)\s+(.+?)(?:\s+over\s+(.+))?$", r"(?:always use|always prefer)\s+(.+)"]
