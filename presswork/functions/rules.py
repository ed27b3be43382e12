"""Fixed values of the news rules: words, patterns, tables and weights, as the results require them."""

# --- fixed values: text ---
STOPWORDS = (
    "a", "an", "the", "is", "on", "at", "for", "with", "by", "to", "in", "of", "and", "that", "this", "it", "from", "as", "are", "was",
    "were", "be", "been", "has", "have", "had", "do", "does", "did", "about", "into", "through",
)
TRACKING = ("ref", "source", "sys_id", "click_id", "fbclid", "gclid", "campaign")

# --- fixed values: publishers by tier ---
TIER_1 = (
    "sebi", "rbi", "nse", "bse", "ministry of finance", "ministry of corporate affairs", "mca", "pib", "press information bureau",
    "sebi press release", "rbi press release", "investor relations", "official filing", "bseindia", "nseindia", "cbic", "cbdt",
    "income tax department", "irdai", "pfrda",
)
TIER_2 = (
    "reuters", "bloomberg", "economic times", "moneycontrol", "business standard", "livemint", "mint", "financial times",
    "financial express", "cnbc-tv18", "cnbctv18", "bqprime", "bloombergquint", "ndtv profit", "the hindu businessline",
    "hindu businessline", "business line", "et now", "zee business", "wsj", "wall street journal", "the hindu", "indian express",
    "hindustan times business",
)
TIER_3 = (
    "techcrunch", "yourstory", "inc42", "entrackr", "business today", "forbes india", "vccircle", "the ken", "morning context",
    "outlook business", "cnbc", "forbes", "reuters india", "ani", "pti", "press trust of india",
)
TIER_SCORES = {1: 100, 2: 85, 3: 68, 4: 42}

# --- fixed values: entities ---
COMPANIES = (
    "tata motors", "tata", "reliance", "jio", "infosys", "wipro", "hdfc", "sbi", "navi", "zepto", "zomato", "paytm", "adani",
    "ather energy", "ather", "ola", "lic", "bse", "nse", "makemytrip", "cult.fit", "cultfit", "biocon", "lohia corp", "sembcorp",
    "carlsberg", "manipal health", "l&t", "infy", "air india", "indigo", "tcs", "byjus", "physics wallah", "swiggy", "google",
    "apple", "microsoft", "amazon", "tesla", "nvidia",
)
COMPANIES_UPPER = ("bse", "nse", "lic", "tcs", "l&t", "infy")
COMPANY_VERBS = "(?:raises|invests|reports|announces|launches|files|plans|debuts|lists|unveils|partners|acquires|merges|hires|eyes|seeks|[Ss]aid\\s+to\\s+\\w+)"
COMPANY_STOPS = (
    "SEBI", "RBI", "INDIA", "US", "IPO", "GMP", "SENSEX", "NIFTY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY",
    "SUNDAY",
)
REGULATORS = (
    "sebi", "rbi", "irdai", "pfrda", "mca", "cbic", "cbdt", "ministry of finance", "ministry of corporate affairs",
    "reserve bank of india", "securities and exchange board", "securities and exchange board of india",
)
PUBLISHERS = (
    "reuters", "bloomberg", "bloomberg.com", "pti", "press trust of india", "ani", "moneycontrol", "moneycontrol.com", "livemint", "mint",
    "economic times", "the economic times", "business standard", "financial times", "financial express", "techcrunch", "yourstory",
    "tradingview", "linkedin", "cnbc", "cnbc-tv18", "cnbctv18", "bqprime", "bloombergquint", "ndtv profit", "the hindu businessline",
    "hindu businessline", "business line", "et now", "zee business", "wsj", "wall street journal", "the hindu", "indian express",
    "the indian express", "hindustan times", "forbes", "forbes india", "vccircle", "the ken", "morning context", "outlook business",
    "inc42", "entrackr", "business today", "rediff", "ndtv", "theprint", "times of india", "the times of india", "upstox",
)
NON_COMPANIES = REGULATORS + PUBLISHERS
PEOPLE = (
    "mukesh ambani", "ambani", "ratan tata", "nikhil kamath", "bhavish aggarwal", "byju raveendran", "natarajan chandrasekaran",
    "karan adani", "gautam adani", "kunal shah", "sridhar vembu", "deepinder goyal", "ritesh agarwal",
)
PEOPLE_TITLES = "(?:CEO|Founder|Chairman|MD|CFO)"
COUNTRIES = ("india", "us", "usa", "china", "uk", "germany", "japan", "singapore", "uae", "vietnam", "france", "spain", "russia", "bangladesh")
SECTORS = {
    "ev": ("ev", "electric vehicle", "battery", "lithium"),
    "fintech": ("fintech", "payment", "banking", "lending", "wallet", "upi"),
    "telecom": ("telecom", "5g", "spectrum", "broadband", "jio", "airtel"),
    "ai": ("ai", "artificial intelligence", "llm", "deep learning", "machine learning"),
    "saas": ("saas", "software as a service", "enterprise software"),
    "e-commerce": ("e-commerce", "quick commerce", "delivery", "retail", "marketplace"),
    "semiconductor": ("semiconductor", "chip", "foundry", "silicon", "fab"),
    "automobile": ("automobile", "automotive", "car", "suv", "truck", "motors"),
    "banking": ("banking", "bank", "lender", "credit"),
    "pharma": ("pharma", "biotech", "healthcare", "hospital", "drug"),
}
PURE_REGULATORS = ("sebi", "rbi")

# --- fixed values: categories and their further tags, in order ---
CATEGORIES = (
    ("IPO", ("ipo", "drhp", "draft papers", "listing day", "listings", "public issue")),
    ("FUNDING", ("raises", "funding round", "series a", "series b", "series c", "seed funding", "venture capital", "raised $", "raised ₹")),
    ("M&A", ("acquisition", "acquires", "merger", "buyout", "takeover", "merges with")),
    ("REGULATORY", ("rbi", "sebi", "mca", "regulatory", "penalty", "sebi bars", "rbi imposes", "compliance", "notice")),
    ("MARKET", ("sensex", "nifty", "bull run", "stock market", "indices", "nasdaq", "bse", "nse", "global markets")),
    ("MARKET_MOVES", ()),
    ("STOCK", ("dividend", "bonus issue", "stock split", "shares jump", "shares fall", "shares rally", "ticker")),
    ("ECONOMY", ("gdp", "inflation", "cpi", "fiscal deficit", "tax collection", "gst", "economic growth", "interest rates")),
    ("STARTUP", ("startup", "unicorn", "founder", "incubator", "y combinator")),
    ("TECH", ("semiconductor", "ai", "artificial intelligence", "software", "chip", "robotics", "ev", "electric vehicle")),
    ("GLOBAL", ("fed hike", "us inflation", "china economy", "opec", "global oil", "eurozone")),
    ("BUSINESS", ("capex", "investment", "factory", "manufacturing", "announces", "plans to invest", "expansion", "jv")),
)
#: Tags of a rule: with substrings (or always, if none), or between word boundaries.
CATEGORY_TAGS = {
    "IPO": (("REGULATORY", ("sebi",)), ("MARKET", ("gmp", "premium"))),
    "FUNDING": (("STARTUP", ()), ("FINTECH", ("fintech",))),
    "M&A": (("BUSINESS", ("deal",)),),
    "REGULATORY": (("FINANCE", ("bank", "fintech")),),
    "MARKET": (("STOCK", ("shares",)),),
    "MARKET_MOVES": (("STOCK", ()),),
    "STOCK": (("MARKET", ()),),
    "ECONOMY": (("REGULATORY", ("rbi",)),),
    "STARTUP": (("FUNDING", ("funding", "round")),),
    "TECH": (("EV", r"\bev\b"), ("AI", r"\bai\b")),
    "GLOBAL": (("ECONOMY", ()),),
    "BUSINESS": (("TECH", r"\bev\b"),),
}
MOVE_VERBS = (
    "jump", "jumps", "surge", "surges", "gain", "gains", "rally", "rallies", "climb", "climbs", "soar", "soars", "fall", "falls", "drop",
    "drops", "slide", "slides", "plunge", "plunges", "slip", "slips", "rise", "rises", "rose",
)
PERCENT = r"\d+(?:\.\d+)?\s*%"

# --- fixed values: event types, in order, by words of the title ---
EVENTS_1 = (
    ("FUNDING", ("raises", "raised", "funding")),
    ("ACQUISITION", ("acquires", "acquisition", "buyout")),
    ("MERGER", ("merger", "merges")),
    ("IPO_FILING", ("files drhp", "draft papers", "files ipo")),
    ("IPO_PRICING", ("ipo pricing", "price band", "ipo price")),
)
LISTING_NOT = ("listing date", "listing timeline", "listing plans", "potential listing", "biggest listing", "ipo timing", "expected to hit", "could become")
LISTING = (
    "shares listed", "lists at", "lists on nse", "lists on bse", "makes market debut", "market debut", "shares debut", "stock debuts",
    "debuts on", "trading begins", "begins trading", "debut on dalal street", "lists with a premium", "debuts at",
)
EARNINGS = ("q1", "q2", "q3", "q4", "quarterly", "earnings")
EVENTS_2 = (
    ("INVESTMENT", ("invest", "investment", "capex", "plans to spend")),
    ("STOCK_MOVEMENT", ("shares jump", "shares surge", "stock climbs", "shares fall", "shares drop", "hits record high")),
    ("PRODUCT_LAUNCH", ("launches", "unveils", "introduces")),
    ("PARTNERSHIP", ("partners", "partnership", "signs agreement")),
    ("REGULATORY_ACTION", ("penalty", "regulatory action", "fines", "sebi bars", "rbi imposes")),
    ("LEADERSHIP_CHANGE", ("appoints", "ceo", "cfo", "resigns", "chairman")),
    ("EXPANSION", ("expands", "expansion")),
    ("LAYOFF", ("layoff", "lays off", "job cuts")),
    ("LEGAL", ("lawsuit", "sues", "legal")),
    ("POLICY_CHANGE", ("rate hike", "gst rate", "policy change")),
)
CLUSTERABLE = (
    "FUNDING", "ACQUISITION", "MERGER", "IPO_FILING", "IPO_PRICING", "IPO_LISTING", "IPO_ANNOUNCEMENT", "EARNINGS", "PROFIT_UPDATE",
    "REVENUE_UPDATE", "STOCK_MOVEMENT", "REGULATORY_ACTION", "LAYOFF", "INVESTMENT", "EXPANSION", "POLICY_CHANGE",
)

# --- fixed values: content types ---
CALENDAR = (
    r"\bto\s+(?:post|declare|announce|report)\s+earnings\b", r"\bto\s+post\s+results\b", r"\bearnings\s+(?:calendar|today|on\s+\w+\s+\d+)\b",
    r"\bcompanies?\s+(?:launch|launching)\s+ipos?\b", r"\b\d+\+?\s+companies\b", r"\bipos?\s+(?:launching|to\s+open)\s+next\s+week\b",
)
ROUNDUP = (r"\bthis\s+week\b.*\b(raised|funding|ipo)\b", r"\braised\s+over\b", r"\bweekly\s+(roundup|wrap|digest)\b", r"\btop\s+\d+\s+(startups|companies|deals)\b")
ADVICE = (
    r"\bshould\s+you\s+buy\b", r"\bstocks?\s+to\s+buy\b", r"\bwhat\s+investors?\s+should\s+do\b", r"\bshould\s+investors\b",
    r"\bbuy\s+or\s+sell\b", r"\bsubscribe\b.*\brecommendation",
)
FORECAST = (
    r"\bhow\s+will\b.*\bbehave\b", r"\bwhy\s+(?:will|may|might|could)\s+.*\brise\b", r"\bwhy\s+markets?\s+may\b", r"\bwill\s+\d{4}\s+be\b",
    r"\bwill\s+markets?\b", r"\bcan\s+the\s+market\b", r"\bwhat\s+to\s+expect\b", r"\bwhat\s+happens\s+next\b",
)
OPINION = (
    r"\|\s*explained\s*$", r"\bexplained\b", r"\banalysis\b", r"\boutlook\b", r"\b(view|perspective)\s*:", r"\bview\s+on\b",
    r"\bcould\s+this\b", r"\bhere.?s\s+why\b", r"\bexperts?\s+explain\b", r"\bfactors?\s+driving\b", r"\bwhy\b",
)
ANCHOR = r"\d+(?:\.\d+)?\s*%.{0,25}\b(after|following|as|on)\b|\bafter\s+(earnings|results|profit|quarterly|q[1-4])\b"
WRAP = (
    r"\bsensex\s+today\b", r"\bstock\s+market\s+live\b", r"\bmarket\s+live\b",
    r"\b\d+\s+factors?\s+(?:driving|behind|fueling)\s+(?:the\s+)?(?:market|rally|sensex|nifty)\b", r"\bwhat\s+will\s+drive\s+d-street\b",
)
CATALYST = r"\b(crash|crashes|plunge|plunges|record\s+high|record\s+low|policy\s+announcement|rate\s+(?:hike|cut)|historic|circuit)\b"
POINTS = r"(?i)\b([\d,]+)\s*(?:points?|pts)\b"
MOVE = (
    r"\b(sensex|nifty|market|markets|stocks?|shares?)\b.{0,40}\b(rises?|rose|jumps?|surges?|falls?|fell|drops?|plunges?|gains?|climbs?)\b"
    r".{0,20}\d+(?:\.\d+)?\s*(?:%|points?|pts)\b"
)

# --- fixed values: noise ---
LISTICLE = (
    r"^\s*\d+\s+(stocks|shares|things|reasons|ways|tips|charts)\b", r"\btop\s+\d+\b", r"\bstocks?\s+to\s+watch\b",
    r"\bthings?\s+(investors|traders)\s+should\s+know\b", r"\bmay\s+rise\b.*\btoday\b", r"\b\d+\s+stocks?\s+that\s+(could|may|might)\b",
)
FILLER = (
    r"\bmarket\s+experts?\s+say\b", r"\bgeneric\s+market\s+outlook\b", r"\bwhat\s+to\s+expect\s+(today|this\s+week)\b",
    r"\banalysts?\s+(believe|expect|predict)\b.*\boutlook\b",
)
FLUFF = (
    r"\bhis\s+(inspiring\s+)?journey\b", r"\bhow\s+he\s+built\b", r"\bhow\s+she\s+built\b", r"\bsuccess\s+story\b",
    r"\battends?\s+(the\s+)?(event|summit|conference|gala)\b", r"\bwins?\s+(an?\s+)?(award|recognition)\b", r"\bfelicitated\b",
    r"\bmotivational\b", r"\binspirational\b",
)
NUMBERS = r"\d+(?:\.\d+)?\s*%|[$₹]\s*\d|\brs\.?\s*\d|\bcrore\b|\bcr\b|\bbillion\b|\bmillion\b|\blakh\b"
NOISE_LISTICLE = "listicle-shaped headline (e.g. 'N stocks to watch')"
NOISE_FILLER = "generic market-outlook filler with no new information"
NOISE_FLUFF = "motivational/PR fluff with no financial materiality"
NOISE_EMPTY = "no identifiable company, numbers, or material event type"
NOISE_BARE = "noise-shaped headline with no material event or numbers backing it"
NOISE_GROUNDED = "noise-shaped headline, but grounded in a material event/number — discounted, not rejected"

# --- fixed values: relevance and ageing ---
INDIA = (
    "rbi", "sebi", "nse", "bse", "sensex", "nifty", "gst", "cbic", "cbdt", "ministry of finance", "niti aayog", "sebi bars",
    "rbi imposes", "reserve bank of india", "securities and exchange board",
)
INDIA_MONEY = ("crore", "cr", "lakh", "₹", "rupee", "rupees", "inr")
GLOBAL_MACRO = (
    "fed rate", "federal reserve", "us inflation", "us fed", "opec", "crude oil", "brent crude", "china economy", "global oil", "eurozone",
    "dollar index", "us treasury yield", "global recession", "commodity prices", "global markets",
)
CITIES = ("mumbai", "delhi", "bengaluru", "bangalore", "hyderabad", "chennai", "kolkata", "pune", "ahmedabad", "gurugram", "gurgaon", "noida")
LONG_CYCLE = ("IPO_FILING", "IPO_ANNOUNCEMENT", "IPO_PRICING", "IPO_LISTING", "ACQUISITION", "MERGER", "REGULATORY_ACTION")
ONGOING = ("ongoing", "probe", "investigation", "pending", "in progress", "continues", "continuing", "still under", "yet to")

# --- fixed values: scores ---
IMPACT = (
    (22, ("rbi penalty", "sebi penalty", "sebi bars", "rbi imposes", "regulatory probe")),
    (20, ("sensex record", "nifty record", "all-time high", "market crash", "stocks crash")),
    (15, ("earnings surge", "quarterly profit jumps", "shares surge", "shares plunge")),
    (15, ("ipo file", "draft papers", "drhp", "ipo listing", "debuts on market")),
    (10, ("investment", "capex", "expands", "expansion")),
)
NOVEL = ((15, ("breaking", "first time", "record high", "historic", "landmark", "unprecedented", "sets record")), (10, ("surges", "plunges", "slashed", "hikes", "bans")))
AUDIENCE = ("ipo", "gmp", "zepto", "tata", "ambani", "reliance", "navi", "funding round")
AUDIENCE_2 = ("ev", "electric vehicle", "ai", "semiconductor", "stock market", "inflation")
DISCUSSION = ("layoff", "job cuts", "ban", "loss", "valuation drops", "valuation cut", "rate hike", "tax", "gst")
DISCUSSION_2 = ("ipo pricing", "valuing at", "investment")
BRANDS = ("tata", "reliance", "ambani", "zepto", "navi", "zomato", "paytm", "adani", "physics wallah", "cult.fit", "ather", "make_my_trip")
MONEY_TOKENS = ("$", "₹", "rs", "crore", "cr", "billion", "million")
SHARE_WORDS = ("surge", "plunge", "crash", "layoff", "record", "why", "how", "warning", "ban")
REASONS = (
    ("market_impact", 25, "This story is involved in a market-moving event (regulatory action, record move, or major shift)."),
    ("financial_significance", 20, "This story's story carries a significant financial figure."),
    ("novelty", 15, "This is a first-of-its-kind or record-setting development for This story."),
    ("india_relevance", 100, "Directly tied to Indian markets/regulators, which is this feed's core focus."),
)

# --- fixed values: facts ---
CURRENCY = (
    r"((?:\$|₹|inr|rs|usd)\s*\d[\d,]*(?:\.\d+)?\s*(?:billion|million|crore|cr|m|b)?\b|\b\d[\d,]*(?:\.\d+)?\s*(?:crore|cr|million|billion)\b)"
)
MONEY_FACTS = (
    ("funding_amount", 0.90, ("raises", "raised", "funding round", "seed round", "series a", "series b", "series c", "raised capital")),
    ("valuation", 0.90, ("valuation", "valued at", "value of", "worth")),
    ("acquisition_value", 0.95, ("acquired for", "acquisition for", "merger value", "buys for", "takeover of")),
)
IPO_SIZE = ("size", "aims to raise", "public issue", "plan to raise", "target")
PRICE_BAND = ("price band", "price range", "ipo price", "pricing")
STOCK_NOUNS = ("shares", "stock", "nifty", "sensex")
STOCK_VERBS = ("jump", "surge", "gain", "rise", "fall", "drop", "plunge", "slide", "slip", "down")
STOCK_DOWN = ("fall", "drop", "plunge", "slide", "slip", "down", "lower")
SUBSCRIPTION = ("subscribed", "subscription", "bid", "bids")
RESULTS = ("revenue", "profit", "net income", "loss", "sales")
HIGH_SEVERITY = ("funding_amount", "valuation", "acquisition_value", "ipo_size", "profit", "revenue", "loss")
OFFICIAL = ("sebi", "rbi", "filing", "official", "announcement", "release", "press")
NUMERIC_FACTS = ("funding_amount", "valuation", "acquisition_value", "ipo_size", "revenue", "profit", "loss", "stock_movement", "subscription_number")
NEGATIVE_EVENTS = ("LAYOFF", "REGULATORY_ACTION", "LEGAL")
POSITIVE_EVENTS = ("FUNDING", "IPO_LISTING", "PARTNERSHIP", "PRODUCT_LAUNCH", "EXPANSION")
ANGLES = {
    "FUNDING": ("number_led", "consequence", "investor_angle", "explainer"),
    "ACQUISITION": ("consequence", "second_order", "number_led", "explainer"),
    "MERGER": ("consequence", "second_order", "explainer"),
    "IPO_FILING": ("number_led", "curiosity", "investor_angle"),
    "IPO_ANNOUNCEMENT": ("number_led", "curiosity", "investor_angle"),
    "IPO_PRICING": ("number_led", "data_led", "investor_angle"),
    "IPO_LISTING": ("breaking", "question", "investor_angle"),
    "STOCK_MOVEMENT": ("contrast", "data_led", "second_order"),
    "PROFIT_UPDATE": ("contrast", "data_led", "surprise"),
    "REVENUE_UPDATE": ("data_led", "contrast", "explainer"),
    "EARNINGS": ("data_led", "contrast", "surprise"),
    "REGULATORY_ACTION": ("consequence", "breaking", "explainer"),
    "LAYOFF": ("consequence", "data_led", "explainer"),
    "INVESTMENT": ("number_led", "consequence", "investor_angle"),
    "EXPANSION": ("consequence", "explainer"),
    "POLICY_CHANGE": ("consequence", "explainer", "second_order"),
    "PARTNERSHIP": ("explainer", "consequence"),
    "PRODUCT_LAUNCH": ("curiosity", "explainer"),
    "LEADERSHIP_CHANGE": ("consequence", "explainer"),
    "LEGAL": ("consequence", "breaking"),
}
DEFAULT_ANGLES = ("explainer", "question")
WHY = {
    "FUNDING": "This capital infusion provides {company} with immediate runway, supporting scaling, hiring, and expansion operations.",
    "INVESTMENT": "Strategic investments validate {company}'s market fit and signal backing from sophisticated financial allocators.",
    "IPO_FILING": "Filing draft papers for a public debut transitions {company} toward high regulatory scrutiny and opens liquidity channels for early backers.",
    "IPO_LISTING": "Listing on public exchanges provides retail access and marks a critical maturity phase for {company}'s capitalization table.",
    "ACQUISITION": "Consolidating operations through acquisition alters market dynamics and expands the acquirer's product portfolio or customer reach.",
    "MERGER": "Mergers combine operational capacities and synergies, aiming for cost efficiencies and combined market footprint.",
    "PROFIT_UPDATE": "Stronger profit performance indicates operational efficiency, improving cash flows and bolstering investor confidence in {company}.",
    "REGULATORY_ACTION": "SEBI/RBI regulatory oversight ensures retail protection and market integrity, though it may trigger governance or compliance overheads.",
    "PRODUCT_LAUNCH": "Releasing new products signals active R&D and marks entry into adjacent competitive segments for {company}.",
}
WHY_DEFAULT = "This development indicates strategic movements within the company's operating sector and triggers adjacent industry ripples."
