"""The lists, weights and thresholds that results depend on."""

TRUSTED_EVENT_PLATFORMS = (
    "devfolio.co", "unstop.com", "hackerearth.com", "hack2skill.com", "mlh.io", "kaggle.com", "devpost.com",
    "eventbrite.com", "eventbrite.in", "meetup.com", "lu.ma", "townscript.com", "allevents.in",
)
KNOWN_FORM_PROVIDERS = ("forms.gle", "docs.google.com", "forms.office.com", "microsoft.com", "typeform.com", "tally.so", "airtable.com", "zoho.com")
SHORT_URL_HOSTS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "tiny.cc")
UNIVERSITY_SUFFIXES = (".ac.in", ".edu.in", ".edu", ".ac.uk")
GOVERNMENT_SUFFIXES = (".gov.in", ".nic.in", ".gov", ".mygov.in")
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid",
    "igshid", "_ga", "ref", "referrer", "source",
)
TWO_PART_SUFFIXES = (
    "co.in", "ac.in", "edu.in", "gov.in", "nic.in", "org.in", "net.in", "res.in", "co.uk", "ac.uk", "org.uk", "gov.uk",
    "com.au", "org.au", "co.nz",
)
STOPWORDS = (
    "the", "and", "for", "with", "from", "join", "annual", "official", "presents", "2026", "2025", "2027", "india",
    "online", "event", "events",
)
INDIAN_CITIES = (
    "bengaluru", "mumbai", "delhi", "hyderabad", "chennai", "pune", "kolkata", "ahmedabad", "jaipur", "bhubaneswar",
    "kochi", "chandigarh", "noida", "gurugram", "indore", "surat", "nagpur", "lucknow", "kanpur", "mysuru", "mysore",
    "coimbatore", "kozhikode", "thiruvananthapuram", "guwahati", "patna", "bhopal", "vijayawada",
)
EVENT_URL_HINTS = ("hackathon", "hackfest", "hack-", "hack/", "techfest", "ideathon", "datathon", "challenge", "competition", "innov", "event")
BASE_TOPICS = (
    "hackathon India", "online hackathon India", "AI hackathon India", "cybersecurity hackathon India",
    "college hackathon India", "student hackathon India", "coding competition India", "developer challenge India",
    "innovation challenge India", "datathon India", "ML hackathon India", "blockchain hackathon India",
    "open source hackathon India",
)
COVERED_CITIES = (
    "Kolkata", "Bengaluru", "Mumbai", "Delhi", "Hyderabad", "Chennai", "Pune", "Ahmedabad", "Jaipur", "Bhubaneswar",
    "Kochi", "Chandigarh", "Noida", "Gurugram", "Indore", "Surat", "Nagpur", "Lucknow", "Coimbatore", "Guwahati",
    "Mysuru", "Thiruvananthapuram", "Kozhikode", "Vijayawada", "Bhopal", "Patna", "Kanpur", "Varanasi", "Madurai",
    "Visakhapatnam", "Hubballi", "Mangaluru", "Dehradun", "Ranchi", "Raipur", "Udaipur", "Jodhpur", "Kota", "Nashik",
    "Vadodara", "Rajkot", "Ludhiana", "Amritsar", "Prayagraj", "Agra", "Gwalior", "Jabalpur", "Dhanbad", "Jamshedpur",
    "Siliguri", "Cuttack", "Rourkela", "Warangal", "Salem", "Tiruchirappalli", "Puducherry",
)
CITY_TEMPLATES = ("hackathon {city}", "tech event {city} 2026", "coding competition {city}", "AI hackathon {city}")
TRACKED_FIELDS = ("title", "organizer_name", "start_date", "end_date", "registration_deadline", "city", "venue", "registration_url")
CITY_ALIASES = {
    "bangalore": "Bengaluru", "bengaluru": "Bengaluru", "bombay": "Mumbai", "mumbai": "Mumbai", "calcutta": "Kolkata",
    "kolkata": "Kolkata", "madras": "Chennai", "chennai": "Chennai", "poona": "Pune", "pune": "Pune",
    "hyderabad": "Hyderabad", "delhi": "Delhi", "new delhi": "Delhi", "ahmedabad": "Ahmedabad", "jaipur": "Jaipur",
    "bhubaneswar": "Bhubaneswar", "bhubaneshwar": "Bhubaneswar", "kochi": "Kochi", "cochin": "Kochi",
    "chandigarh": "Chandigarh", "noida": "Noida", "gurugram": "Gurugram", "gurgaon": "Gurugram",
}
#: In the order of the score's breakdown.
SIGNAL_WEIGHTS = {
    "officialOrganizerPage": 25, "officialRegistrationLink": 20, "organizerSocialConfirmation": 15,
    "trustedEventPlatform": 10, "secondIndependentSource": 10, "validHttps": 5, "consistentDates": 5,
    "consistentOrganizer": 5, "recentConfirmation": 5, "suspiciousRedirect": -20, "unknownRegistrationDomain": -25,
    "conflictingOfficialInfo": -30, "phishingMalwareReputation": -40, "impersonationIndicators": -50,
    "confirmedMalicious": -100,
}
PUBLISH_AT, REVIEW_AT, TIER_A_AT, GRACE_HOURS = 70, 45, 60, 26
SIMILAR, SIMILAR_WITH_PLACE = 0.85, 0.7
TRUST_STEPS = {"valid": 3, "dead_link": -2, "fake": -8, "duplicate": -1}
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"ignore\s+your\s+instructions",
    r"send\s+(me\s+)?(your|the)\s+(api\s*key|bot\s*token|token|secret|password)",
    r"disregard\s+.*instructions",
    r"you\s+are\s+now\s+(a|an)\s+",
    r"execute\s+.*(command|script|code)",
    r"download\s+(and\s+)?(run|execute|install)\s+",
    r"enter\s+(your|the)\s+(password|otp|pin|credentials)\s+to\s+register",
    r"system\s*:\s*you",
    r"\[system\]",
    r"<\|?(system|assistant|user)\|?>",
)
#: Letters that look like Latin ones, and the Latin ones.
CONFUSABLES = (
    "асеіїјорѕхуһкмнт"
    "АСЕІЈОРЅХУНКМТ"
    "ιορχυνκΙΟΡΧΥΝΚ",
    "aceiijopsxyhkmhtACEIJOPSXYHKMTiopxuvkIOPXYNK",
)
ABBREVIATIONS = {"sih": "smart india hackathon", "sawo": "smart india hackathon"}
SITEMAP_EXCLUDED = (r"\.pdf$", r"\.jpg$", r"\.png$", "/tag/", "/author/", "/page/")
