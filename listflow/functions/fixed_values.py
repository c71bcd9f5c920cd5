"""Word lists, lookup tables, constants and patterns.

They decide the results, so they are stated plainly, in their working order.
Every function that uses one takes it as a default argument, so a caller may
pass another list.
"""

# ---------------------------------------------------------------- domains
COMPANY_TYPES = ["startup", "big_tech", "stealth", "vc_backed", "remote_first", "other"]
REMOTE_TYPES = ["remote", "hybrid", "onsite"]
EXPERIENCE_LEVELS = ["intern", "junior", "mid", "senior", "lead", "staff", "principal"]
JOB_TYPES = ["full-time", "part-time", "contract", "freelance", "internship"]

# ---------------------------------------------------------------- ages (days)
EXPIRY_DAYS = 45
KEYWORD_RANK_DAYS = 21
RESUME_RANK_DAYS = 30
TRENDING_DAYS = 7
NEW_MINUTES = 10
POSTED_WITHIN_DAYS = {"24h": 1, "week": 7, "month": 30}
POSTED_WITHIN_DEFAULT_DAYS = 30

# ---------------------------------------------------------------- lookups
LOCATION_ALIASES = {
    "india": "IN", "united states": "US", "usa": "US", "united kingdom": "GB",
    "uk": "GB", "canada": "CA", "australia": "AU",
}
COUNTRY_NAMES = {
    "in": "India", "us": "United States", "gb": "United Kingdom", "ca": "Canada",
    "au": "Australia", "de": "Germany", "sg": "Singapore", "fr": "France",
    "nl": "Netherlands",
}
FEED_COUNTRY_CODES = [
    ("uk", "gb"), ("united kingdom", "gb"), ("canada", "ca"), ("australia", "au"),
    ("germany", "de"), ("france", "fr"), ("india", "in"), ("netherlands", "nl"),
    ("brazil", "br"), ("singapore", "sg"),
]
FEED_CATEGORIES = [
    ("software", "Software Engineering"), ("engineer", "Software Engineering"),
    ("data", "Data Science"), ("design", "Design"), ("product", "Product"),
    ("marketing", "Marketing"),
]
JOB_TYPE_SYNONYMS = {
    "fulltime": "full-time", "full_time": "full-time", "full-time": "full-time",
    "parttime": "part-time", "part_time": "part-time", "part-time": "part-time",
    "contract": "contract", "contractor": "contract", "freelance": "freelance",
    "intern": "internship", "internship": "internship",
}
JOB_TYPE_CLEANUP = {
    "fulltime": "full-time", "full_time": "full-time", "full time": "full-time",
    "parttime": "part-time", "part_time": "part-time", "part time": "part-time",
    "contractor": "contract", "freelancer": "freelance", "intern": "internship",
}
FEED_LEVEL_NAMES = {
    "entry level": "junior", "mid level": "mid", "senior level": "senior",
    "management": "lead", "internship": "intern",
}
EMPLOYEE_ESTIMATES = {
    "big_tech": "10,000+ employees", "vc_backed": "50 – 500 employees",
    "stealth": "1 – 50 employees",
}
EMPLOYEE_ESTIMATE_DEFAULT = "10 – 200 employees"

# ---------------------------------------------------------------- company type
STEALTH_PATTERNS = [
    r"stealth\s*(startup|company|mode)?", r"confidential\s*(company|employer)?",
    r"undisclosed", r"well[-\s]?funded\s+startup", r"pre[-\s]?launch\s+startup",
]
BIG_TECH = [
    "google", "alphabet", "meta", "facebook", "apple", "amazon", "microsoft", "netflix",
    "nvidia", "tesla", "salesforce", "adobe", "oracle", "ibm", "intel", "amd", "qualcomm",
    "cisco", "samsung", "uber", "lyft", "doordash", "palantir", "snowflake", "datadog",
    "cloudflare", "twilio", "shopify", "atlassian", "spotify", "block", "paypal",
    "coinbase", "robinhood",
]
VC_PORTFOLIOS = [
    ("YC", [
        "airbnb", "stripe", "dropbox", "coinbase", "instacart", "doordash", "reddit",
        "twitch", "gitlab", "zapier", "gusto", "brex", "scale ai", "fivetran", "webflow",
        "vercel", "supabase", "posthog", "retool", "segment", "algolia", "docker",
        "render", "railway", "resend", "mercury", "deel", "lattice", "ramp", "rippling",
        "notion",
    ]),
    ("a16z", [
        "github", "coinbase", "instacart", "lyft", "slack", "figma", "roblox",
        "databricks", "replit", "sourcegraph", "vercel", "netlify", "hashicorp",
        "datadog", "asana",
    ]),
    ("Sequoia", [
        "apple", "google", "whatsapp", "stripe", "zoom", "snowflake", "unity", "figma",
        "notion", "linear", "vercel", "scale ai", "hugging face", "vanta",
    ]),
    ("KP", ["google", "amazon", "twitter", "slack", "figma", "canva", "rippling", "plaid"]),
    ("Accel", [
        "facebook", "dropbox", "slack", "atlassian", "crowdstrike", "freshworks",
        "notion", "vercel", "webflow", "snyk", "1password", "miro",
    ]),
    ("GV", [
        "uber", "slack", "stripe", "gitlab", "medium", "hubspot", "duolingo",
        "robinhood", "gusto",
    ]),
    ("Lightspeed", ["snap", "affirm", "epic games", "mulesoft", "nutanix", "rubrik", "grafana"]),
    ("Benchmark", [
        "twitter", "uber", "snapchat", "discord", "zillow", "yelp", "dropbox", "elastic",
    ]),
    ("Tiger Global", [
        "stripe", "figma", "brex", "notion", "canva", "databricks", "gitlab", "toast",
    ]),
    ("Bessemer", [
        "shopify", "twilio", "linkedin", "pinterest", "canva", "toast", "fivetran",
        "intercom",
    ]),
]
BULK_BIG_TECH = [
    "google", "meta", "amazon", "apple", "microsoft", "netflix", "uber", "airbnb",
    "stripe", "salesforce", "adobe", "oracle", "ibm", "cisco", "intel", "nvidia",
    "infosys", "tcs", "wipro", "hcl", "cognizant", "tech mahindra", "mindtree",
    "mphasis", "accenture", "capgemini", "deloitte", "zoho", "freshworks", "flipkart",
    "paytm", "swiggy", "zomato", "razorpay", "phonepe",
]
BULK_FUNDING_PHRASES = [
    "series a", "series b", "y combinator", "yc backed", "sequoia", "a16z", "accel",
    "vc backed", "venture",
]

# ---------------------------------------------------------------- perks
PERK_VISA = [
    "visa sponsor", "sponsorship available", "sponsor visa", "h1b", "h-1b", "visa support",
]
PERK_RELOCATION = [
    "relocation support", "relocation assistance", "relocation package",
    "offer relocation", "relocation provided", "willing to relocate",
]
PAGE_VISA = ["visa sponsor", "sponsorship", "h1b", "h-1b", "visa support", "work permit"]
PAGE_RELOCATION = [
    "relocation support", "relocation assist", "relocation package", "relocation provided",
]
BULK_VISA = ["visa sponsorship", "sponsor visa", "h1b", "tier 2", "sponsorship available"]
BULK_RELOCATION = ["relocation support", "relocation package", "relocation assistance"]

# ---------------------------------------------------------------- remote
REMOTE_WORDS = ["remote", "work from home", "wfh", "anywhere"]
PAGE_HYBRID_WORDS = ["hybrid", "partial remote", "flex"]
BULK_HYBRID_WORDS = ["hybrid"]

# ---------------------------------------------------------------- experience level
# Word rules: whole words of the title; the first level that matches wins.
LEVEL_WORDS = [
    ("intern", [r"intern", r"internship", r"trainee", r"apprentice", r"co-?op"]),
    ("principal", [r"principal", r"distinguished", r"fellow"]),
    ("staff", [r"staff", r"vp", r"director", r"chief", r"head\s+of"]),
    ("lead", [r"lead", r"team\s*lead", r"tech\s*lead", r"engineering\s*lead", r"manager"]),
    ("senior", [r"senior", r"architect", r"executive"]),
    ("junior", [r"junior", r"associate", r"entry[\s-]?level", r"graduate", r"new\s*grad", r"fresher"]),
]
LEVEL_ABBREVIATIONS = {"senior": "sr", "junior": "jr"}
RECOVERY_LEVEL_WORDS = [
    ("intern", [r"intern", r"internship", r"trainee", r"apprentice"]),
    ("principal", [r"principal", r"distinguished", r"fellow"]),
    ("staff", [r"staff", r"vp", r"director", r"chief", r"head\s+of"]),
    ("lead", [r"lead", r"tech\s*lead", r"manager"]),
    ("senior", [r"senior", r"architect"]),
    ("junior", [r"junior", r"associate", r"entry[\s-]?level", r"graduate", r"fresher"]),
]
# Substring rules of the page feeds.
PAGE_LEVEL_TERMS = [
    ("intern", ["intern", "fresher", "trainee", "apprentice", "co-op"]),
    ("junior", ["junior", "jr.", "jr ", "associate", "entry level", "entry-level", "graduate"]),
    ("senior", ["senior", "sr.", "sr ", "lead", "principal", "architect"]),
    ("staff", [
        "staff", "principal", "vp", "vice president", "director", "head of", "chief",
        "cto", "ceo",
    ]),
]
DEFAULT_LEVEL = "mid"

# ---------------------------------------------------------------- job type
JOB_TYPE_TERMS = [
    ("internship", ["intern", "internship", "trainee"]),
    ("freelance", ["freelance", "freelancer"]),
    ("contract", ["contract", "contractor"]),
    ("part-time", ["part-time", "part time"]),
]
DEFAULT_JOB_TYPE = "full-time"

# ---------------------------------------------------------------- domain of a title
TITLE_DOMAINS = [
    ("Data Science & Engineering", [
        "data engineer", "data scientist", "data analyst", "analytics", "bi ",
        "business intelligence", "etl", "data pipeline",
    ]),
    ("AI-ML-GenAI", [
        "ml ", "machine learning", "ai ", "artificial intelligence", "deep learning",
        "nlp", "computer vision", "genai", "gen ai", "llm",
    ]),
    ("Product Management", ["product manager", "product owner", "product lead", "product director"]),
    ("Frontend Engineering", [
        "frontend", "front-end", "front end", "react", "vue", "angular", "ui engineer",
        "ui developer",
    ]),
    ("Backend Engineering", ["backend", "back-end", "back end", "api ", "server", "systems engineer"]),
    ("Full Stack Engineering", ["full stack", "fullstack", "full-stack"]),
    ("DevOps & Infrastructure", [
        "devops", "sre", "site reliability", "infrastructure", "platform engineer",
        "cloud engineer",
    ]),
    ("Security", ["security", "cybersecurity", "infosec", "penetration", "vulnerability"]),
    ("Mobile Development", ["mobile", "ios", "android", "flutter", "react native"]),
    ("Design", ["designer", "ux", "ui/ux", "product design"]),
    ("Quantitative Finance", ["quant", "quantitative", "trading"]),
    ("Web3 & Crypto", ["web3", "blockchain", "crypto", "smart contract", "solidity", "defi"]),
]
DEFAULT_TITLE_DOMAIN = "Software Engineering"

# ---------------------------------------------------------------- row quality
FAKE_PREFIXES = ["test ", "mock ", "dummy ", "placeholder "]
GENERIC_TITLES = ["job", "opening", "vacancy", "hiring", "urgent", "required"]
BULK_NON_TECH = [
    "sales", "marketing manager", "human resources", "recruiter", "customer support",
    "customer success", "bpo", "call center", "account executive",
    "business development", "content writer", "copywriter", "talent acquisition",
]
RECOVERY_NON_TECH = BULK_NON_TECH + [
    "receptionist", "secretary", "data entry", "typist", "housekeeping",
]
NON_TECH = RECOVERY_NON_TECH + [
    "driver", "delivery", "cook", "chef", "waiter", "cashier", "clerk", "peon",
    "watchman", "guard", "plumber", "electrician", "carpenter",
]
FOREIGN_COUNTRIES = [
    "uk", "united kingdom", "usa", "united states", "canada", "australia", "germany",
    "france", "netherlands", "switzerland", "sweden", "japan", "singapore", "brazil",
    "spain", "italy", "new zealand", "israel",
]
FOREIGN_CITIES = [
    "london", "new york", "san francisco", "los angeles", "seattle", "austin", "boston",
    "chicago", "toronto", "vancouver", "montreal", "sydney", "melbourne", "berlin",
    "munich", "amsterdam", "dublin", "paris", "zurich", "tokyo",
]
FOREIGN_CURRENCIES = ["gbp", "eur", "chf", "aud", "cad", "sgd"]
FOREIGN_SALARY_PATTERN = r"[£€]\s*[0-9]"
PLACEHOLDER_COMPANIES = ["", "Indian Company", "Indian Startup", "AI Company"]

# ---------------------------------------------------------------- salary text
SALARY_PATTERNS = [
    r"\$\s*([0-9,]+)\s*[kK]\s*[-–—to]+\s*\$?\s*([0-9,]+)\s*[kK]",
    r"\$\s*([0-9,]+)\s*[-–—to]+\s*\$?\s*([0-9,]+)",
    r"([0-9,]+)\s*[kK]\s*[-–—to]+\s*([0-9,]+)\s*[kK]",
]

# ---------------------------------------------------------------- ATS by URL
# (label, substrings of the lower-case URL); a value starting with "re:" is a pattern.
ATS_URL_RULES = [
    ("Greenhouse", ["greenhouse.io", "boards.greenhouse"]),
    ("Lever", ["lever.co"]),
    ("Workday", ["myworkdayjobs.com", "workday.com", r"re:wd[0-9]+\.myworkdayjobs"]),
    ("Ashby", ["ashbyhq.com", "jobs.ashbyhq"]),
    ("iCIMS", ["icims.com"]),
    ("Taleo", ["taleo.net", r"re:oracle.*taleo", "taleo.oracle"]),
    ("SmartRecruiters", ["smartrecruiters.com", "jobs.smartrecruiters"]),
    ("Workable", ["workable.com", "apply.workable"]),
    ("BambooHR", ["bamboohr.com"]),
    ("JazzHR", ["jazzhr.com", "app.jazz.co"]),
    ("Breezy HR", ["breezy.hr"]),
    ("Jobvite", ["jobvite.com", "jobs.jobvite"]),
    ("Recruitee", ["recruitee.com"]),
    ("Personio", ["personio.de", "jobs.personio"]),
    ("Rippling", ["rippling.com"]),
    ("Gusto", ["gusto.com"]),
    ("Deel", ["deel.com"]),
    ("SAP SuccessFactors", ["successfactors.com", r"re:sap\..*career"]),
    ("Wellfound", ["wellfound.com", "angel.co"]),
    ("LinkedIn Jobs", ["linkedin.com"]),
    ("Indeed", ["indeed.co"]),
    ("ZipRecruiter", ["ziprecruiter.com"]),
    ("Glassdoor", ["glassdoor.co"]),
    ("Naukri", ["naukri.com"]),
    ("YC Work at a Startup", ["workatastartup.com"]),
    ("YC Jobs", ["ycombinator.com"]),
    ("Web3 Career", ["web3.career"]),
    ("Simplify", ["simplify.jobs"]),
    ("Adzuna", ["adzuna.co", "adzuna.in"]),
    ("Remotive", ["remotive.com", "remotive.io"]),
    ("RemoteOK", ["remoteok.com", "remoteok.io"]),
    ("Arbeitnow", ["arbeitnow.com"]),
    ("Instahyre", ["instahyre.com"]),
    ("CutShort", ["cutshort.io"]),
    ("Hirist", ["hirist.com", "hirist.tech"]),
    ("HackerEarth", ["hackerearth.com"]),
    ("HackerRank", ["hackerrank.com"]),
    ("Internshala", ["internshala.com"]),
    ("Foundit", ["foundit.in"]),
    ("Shine", ["shine.com"]),
    ("TimesJobs", ["timesjobs.com"]),
    ("IIMJobs", ["iimjobs.com"]),
    ("Freshersworld", ["freshersworld.com"]),
    ("HasJob", ["hasjob.co"]),
    ("Karkidi", ["karkidi.com"]),
    ("ApplyToJob", ["applytojob.com"]),
    ("Teamtailor", ["teamtailor.com"]),
    ("Pinpoint", ["pinpointhq.com"]),
    ("Comeet", ["comeet.co"]),
    ("Hirebridge", ["hirebridge.com"]),
    ("Paylocity", ["paylocity.com"]),
    ("Paycom", ["paycom.com"]),
    ("UKG (UltiPro)", ["ultipro.com"]),
    ("ADP", ["adp.com"]),
    ("Ceridian Dayforce", ["ceridian.com"]),
    ("Eightfold AI", ["eightfold.ai"]),
    ("Jobsoid", ["jobsoid.com"]),
    ("Zoho Recruit", ["zohorecruit"]),
    ("Avature", ["avature.net"]),
    ("Dice", ["dice.com"]),
    ("Monster", ["monster.co"]),
    ("Hired", ["hired.com"]),
    ("Triplebyte", ["triplebyte.com"]),
    ("Dover", ["dover.com"]),
    ("Gem", ["gem.com"]),
    ("Freshteam", ["freshteam.com"]),
    ("Zoho Recruit", [r"re:zoho\.com.*recruit"]),
    ("ApplyBoard", ["applyboard.com"]),
    ("Dealls", ["dealls.com"]),
    ("Clera", ["getclera.com"]),
    ("Direct Apply", ["dataannotation.tech"]),
    ("Himalayas", ["himalayas.app"]),
    ("Jobicy", ["jobicy.com"]),
    ("Arc.dev", ["arc.dev"]),
    ("AI-Jobs.net", ["ai-jobs.net"]),
    ("Google Careers", ["careers.google.com"]),
    ("Microsoft Careers", ["careers.microsoft.com"]),
    ("Amazon Jobs", ["amazon.jobs"]),
    ("Apple Careers", ["jobs.apple.com"]),
    ("Meta Careers", ["metacareers.com", "careers.meta.com"]),
    ("Netflix Jobs", ["netflix.com/jobs", "jobs.netflix.com"]),
    ("Company Career Page", [
        r"re:careers\.[a-z]+\.(com|io|co|in)", r"re:[a-z]+\.com/careers",
        r"re:[a-z]+\.com/jobs", r"re:jobs\.[a-z]+\.(com|io|co|in)",
    ]),
]

# ---------------------------------------------------------------- ATS by company
ATS_COMPANY_RULES = [
    ("Google Careers", ["google", "alphabet"]),
    ("Meta Careers", ["meta", "facebook"]),
    ("Amazon Jobs", ["amazon"]),
    ("Apple Careers", ["apple"]),
    ("Microsoft Careers", ["microsoft"]),
    ("Netflix Jobs", ["netflix"]),
    ("Greenhouse", [
        "uber", "airbnb", "stripe", "coinbase", "figma", "notion", "discord", "ramp",
        "brex", "rippling", "databricks", "snowflake", "datadog", "dbt labs", "phonepe",
        "dream11", "postman", "browserstack", "thoughtspot", "chargebee", "hasura",
        "moengage", "twilio", "cloudflare", "canva", "gitlab", "plaid", "airtable",
        "hashicorp", "elastic",
    ]),
    ("Lever", [
        "swiggy", "zomato", "razorpay", "ola", "meesho", "cred", "byju's", "unacademy",
        "sharechat", "sprinklr", "clevertap", "urbancompany", "licious", "groww",
        "shopify", "lyft", "slack", "asana",
    ]),
    ("Workday", [
        "salesforce", "adobe", "ibm", "cisco", "intel", "nvidia", "qualcomm",
        "cognizant", "accenture", "ey", "kpmg", "pwc", "jpmorgan", "goldman sachs",
        "bank of america", "atlassian", "vmware", "dell", "hp", "honeywell", "siemens",
        "philips", "bosch", "samsung",
    ]),
    ("Taleo", ["oracle"]),
    ("SAP SuccessFactors", ["sap"]),
    ("iCIMS", ["morgan stanley"]),
    ("SmartRecruiters", ["capgemini", "visa"]),
    ("Infosys Careers", ["infosys"]),
    ("TCS iON", ["tcs", "tata consultancy"]),
    ("Tata Elxsi Careers", ["tata elxsi"]),
    ("Wipro Careers", ["wipro"]),
    ("HCL Careers", ["hcl"]),
    ("Tech Mahindra Careers", ["tech mahindra"]),
    ("Mindtree Careers", ["mindtree"]),
    ("Mphasis Careers", ["mphasis"]),
    ("L&T Careers", ["l&t", "larsen"]),
    ("Persistent Careers", ["persistent"]),
    ("LTIMindtree Careers", ["ltimindtree"]),
    ("Hexaware Careers", ["hexaware"]),
    ("Cyient Careers", ["cyient"]),
    ("Birlasoft Careers", ["birlasoft"]),
    ("Zensar Careers", ["zensar"]),
    ("Coforge Careers", ["coforge"]),
    ("NIIT Careers", ["niit"]),
    ("Sonata Careers", ["sonata software"]),
    ("Happiest Minds Careers", ["happiest minds"]),
    ("Company Career Page", ["muthoot"]),
    ("Reliance Careers", ["reliance"]),
    ("Mahindra Careers", ["mahindra"]),
    ("Bajaj Careers", ["bajaj"]),
    ("Aditya Birla Careers", ["aditya birla"]),
    ("Tata Careers", ["tata"]),
    ("Flipkart Careers", ["flipkart"]),
    ("Paytm Careers", ["paytm"]),
    ("Zerodha Careers", ["zerodha"]),
    ("Nykaa Careers", ["nykaa"]),
    ("Freshteam", ["freshworks"]),
    ("Zoho Recruit", ["zoho"]),
    ("Turing Platform", ["turing"]),
    ("UpGrad Careers", ["upgrad"]),
    ("Vedantu Careers", ["vedantu"]),
    ("Lever", ["dunzo", "jupiter", "slice", "rupeek"]),
    ("Deloitte Careers", ["deloitte"]),
    ("McKinsey Careers", ["mckinsey"]),
    ("Bain Careers", ["bain"]),
    ("BCG Careers", ["bcg"]),
]
ATS_SUBDOMAIN_RULES = [
    ("Recruiterbox", ["recruiterbox"]),
    ("RecruitCRM", ["recruitcrm"]),
    ("Breezy HR", ["breezyhr"]),
    ("Lever", ["hire.lever", "jobs.lever"]),
    ("Greenhouse", ["boards.greenhouse", "app.greenhouse"]),
    ("Workday", ["career.workday", "myworkday"]),
    ("SAP SuccessFactors", ["successfactors"]),
    ("SmartRecruiters", ["smartrecruiters"]),
    ("BambooHR", ["bamboohr"]),
    ("JazzHR", ["jazzhr"]),
    ("Ashby", ["ashbyhq"]),
    ("Jobvite", ["jobvite"]),
    ("Recruitee", ["recruitee"]),
    ("Workable", ["workable"]),
    ("Teamtailor", ["teamtailor"]),
    ("Personio", ["personio"]),
    ("Pinpoint", ["pinpointhq"]),
    ("Freshteam", ["freshteam"]),
]
ATS_AGGREGATORS = [
    "Adzuna", "Indeed", "LinkedIn Jobs", "ZipRecruiter", "Glassdoor", "Monster", "Dice",
    "Remotive", "RemoteOK", "Arbeitnow", "Himalayas", "Jobicy", "Arc.dev", "AI-Jobs.net",
]
ATS_UNKNOWN = "Unknown ATS"
DIRECT_APPLY_PROVIDERS = ["Greenhouse", "Lever"]
AGGREGATOR_URL_TERMS = ["adzuna", "indeed.com/rc", "jooble"]
# (provider, ordered patterns); group 1 is the board, group 2 the listing.
ATS_ID_PATTERNS = [
    ("Greenhouse", [
        r"greenhouse\.io/([^/]+)/jobs/([0-9]+)",
        r"boards-api\.greenhouse\.io/v1/boards/([^/]+)/jobs/([0-9]+)",
    ]),
    ("Lever", [r"lever\.co/([^/]+)/([a-f0-9-]+)"]),
    ("Ashby", [r"jobs\.ashbyhq\.com/([^/]+)/([a-f0-9-]+)"]),
    ("Workable", [
        r"apply\.workable\.com/([^/]+)/j/([a-z0-9]+)",
        r"([^.]+)\.workable\.com/j/([a-z0-9]+)",
    ]),
    ("SmartRecruiters", [r"jobs\.smartrecruiters\.com/([^/]+)/([a-f0-9-]+)"]),
    ("BambooHR", [
        r"([^.]+)\.bamboohr\.com/careers/([0-9]+)",
        r"([^.]+)\.bamboohr\.com/jobs/view\.php\?id=([0-9]+)",
    ]),
    ("Recruitee", [r"([^.]+)\.recruitee\.com/o/([^/?]+)"]),
    ("Breezy HR", [r"([^.]+)\.breezy\.hr/p/([a-f0-9]+)"]),
]

# ---------------------------------------------------------------- résumé ranking
KNOWN_SKILLS = [
    "python", "java", "javascript", "typescript", "c++", "c#", "go", "golang", "rust",
    "ruby", "swift", "kotlin", "scala", "php", "perl", "r", "matlab", "lua", "dart",
    "elixir", "react", "angular", "vue", "svelte", "next.js", "nuxt", "gatsby", "remix",
    "node.js", "node", "express", "fastapi", "django", "flask", "spring", "rails",
    "html", "css", "sass", "tailwind", "bootstrap", "sql", "mysql", "postgresql",
    "postgres", "mongodb", "redis", "elasticsearch", "dynamodb", "cassandra", "sqlite",
    "firebase", "supabase", "aws", "azure", "gcp", "docker", "kubernetes", "terraform",
    "ansible", "jenkins", "ci/cd", "github actions", "gitlab ci", "git", "linux",
    "bash", "shell", "tensorflow", "pytorch", "scikit-learn", "pandas", "numpy",
    "spark", "airflow", "machine learning", "deep learning", "nlp", "computer vision",
    "data science", "figma", "sketch", "adobe xd", "graphql", "rest", "api", "grpc",
    "websocket", "agile", "scrum", "jira", "confluence", "selenium", "cypress", "jest",
    "mocha", "pytest", "solidity", "ethereum", "blockchain", "web3", "opencv", "ros",
    "cuda",
]
RESUME_LEVELS = ["intern", "junior", "mid", "senior", "staff"]
RESUME_LEVEL_TERMS = [
    ("intern", ["intern", "fresher", "student", "graduating", "trainee"]),
    ("junior", ["junior", "entry level", "entry-level", "associate", "graduate"]),
    ("senior", ["senior", "sr.", "lead", "principal", "architect"]),
    ("staff", ["staff", "director", "vp ", "head of", "cto"]),
]
RESUME_LEVEL_YEARS = [("junior", 1), ("mid", 4), ("senior", 8)]
RESUME_LEVEL_DEFAULT = "staff"
SKILL_DOMAINS = [
    ("frontend", ["react", "angular", "vue", "svelte", "html", "css", "next.js", "tailwind", "frontend"]),
    ("backend", ["node.js", "express", "django", "flask", "fastapi", "spring", "rails", "backend"]),
    ("fullstack", ["fullstack", "full-stack", "full stack"]),
    ("data", [
        "pandas", "numpy", "spark", "airflow", "data science", "machine learning",
        "tensorflow", "pytorch",
    ]),
    ("devops", ["docker", "kubernetes", "terraform", "ci/cd", "devops", "sre"]),
    ("mobile", ["swift", "kotlin", "react native", "flutter", "ios", "android"]),
    ("security", ["security", "penetration", "cybersecurity", "siem"]),
    ("design", ["figma", "sketch", "ux", "ui design", "prototyping"]),
]
SKILL_DOMAIN_MIN = 2
SKILL_DOMAIN_DEFAULT = "general"
LEVELS_ALLOWED = {
    "intern": ["intern", "junior", "entry", "entry-level", "fresher", "trainee", ""],
    "junior": ["intern", "junior", "entry", "entry-level", "mid", "associate", ""],
    "mid": ["junior", "mid", "senior", ""],
    "senior": ["mid", "senior", "lead", "staff", "principal", ""],
    "staff": ["senior", "lead", "staff", "principal", "director", ""],
}
LEVEL_BONUS = {
    "intern": {"intern": 20, "junior": 10, "mid": -5, "senior": -30, "staff": -40, "lead": -30},
    "junior": {"intern": 5, "junior": 20, "mid": 5, "senior": -25, "staff": -35, "lead": -25},
    "mid": {"intern": -10, "junior": 5, "mid": 20, "senior": 5, "staff": -10, "lead": 0},
    "senior": {"intern": -25, "junior": -15, "mid": 5, "senior": 20, "staff": 10, "lead": 15},
    "staff": {"intern": -30, "junior": -25, "mid": -10, "senior": 10, "staff": 20, "lead": 15},
}
SENIOR_TITLE_TERMS = [
    "senior", "sr.", "sr ", "lead", "principal", "staff", "director", "head ", "vp ",
    "architect", "manager", "expert", "distinguished",
]
LONG_EXPERIENCE_TERMS = ["5+ years", "7+ years", "8+ years", "10+ years"]
RANK_NON_TECH = [
    "sales", "marketing", "hr ", "human resources", "recruiter", "accountant", "nurse",
    "teacher", "driver", "cook", "janitor", "cashier", "legal", "receptionist",
    "secretary", "warehouse", "customer service", "retail",
]

# ---------------------------------------------------------------- scores
MATCH_TIERS = [("perfect", 70), ("strong", 50), ("good", 30)]
UI_TIERS = [("perfect", 80), ("strong", 60), ("good", 40)]
TIER_DEFAULT = "weak"
MIN_MATCH_SCORE = 15
RECENCY_STEPS = [(1, 25), (3, 20), (7, 15), (14, 8)]
RECENCY_OLDER = 2
NO_DATE_AGE = 999
FACET_BONUS = {"experience_level": 5, "remote_type": 3, "job_type": 2}
TRENDING_TITLE_TERMS = [
    "python", "react", "node", "java", "aws", "docker", "kubernetes", "typescript",
    "golang", "rust", "ai", "ml", "data", "cloud", "devops", "fullstack", "frontend",
    "backend", "mobile",
]

# ---------------------------------------------------------------- résumé files
RESUME_EXTENSIONS = ["pdf", "doc", "docx"]
RESUME_MAX_BYTES = 5 * 1024 * 1024

# The words of a résumé match's reasons.
REASON_SKILLS = " matching skills"
REASON_LEVEL = "great level fit"
REASON_DOMAIN = " domain"
REASON_JOINT = " · "
REASON_NONE = "some relevance found"
