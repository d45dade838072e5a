"""Fixed values that results depend on.

FIXED VALUES: these must stay exactly as written for results to agree with
the behaviour being re-created (phone formats of Malaysia, company suffixes,
page labels and skip words). They are listed here together, in their natural
order, and used by the column builders in this package.
"""

# --- FIXED VALUES --------------------------------------------------------

# Phone shapes. Python-style classes are spelled out Unicode-exact below.
# Button labels on map pages:       (\+?6?0\d[\d\s\-]{7,12})
# Phone numbers in website text:    (\+?6?0[1-9][\d\s\-\.]{7,13})
# Chat links:                       (\+?6?01\d{8,9})

# Words near a number that raise confidence (case-insensitive)
CONTEXT_WORDS = ["phone", "tel", "call", "contact", "mobile", "fax", "whatsapp",
                 "hotline", "office", "hubungi", "telefon", "talian"]
# Words that mark a fax number (case-insensitive)
FAX_WORDS = ["fax", "faks", "facsimile"]
# Characters of context kept around a text match
CONTEXT_BEFORE = 60
CONTEXT_AFTER = 20

# Company-name pieces removed, one after the other, anywhere in the name
NAME_REMOVALS = ["sdn. bhd.", "sdn bhd.", "sdn bhd", "bhd.", "bhd", "plt.", "plt",
                 "llp.", "llp", "(m)", "(malaysia)"]

# Directory A result-page anchor texts that are not company names
DIR_A_SKIP_NAMES = ["write a review", "sign in", "employer site", "companies",
                    "community", ""]
DIR_A_BASE = "https://my.jobstreet.com"
DIR_B_BASE = "https://my.hiredly.com"
# Directory A detail labels: label -> (field, value shorter than)
DIR_A_LABELS = [("Website", "website", 200), ("Industry", "category", 200),
                ("Company size", "company_size", 100),
                ("Primary location", "address", 300)]
# Directory B profile lines that are not the company name
DIR_B_SKIP_LINES = ["Companies", "Log In", "Sign Up", "For Employers", "Jobs Search",
                    "Internships", "Drop Resume", "English"]
DIR_B_ADDRESS_LABEL = "Our Address"
# Directory B outbound links that are not the company website
DIR_B_BLOCKED_HOSTS = ["hiredly", "google", "facebook", "linkedin", "twitter",
                       "instagram", "youtube", "tiktok"]

# Contact-page link: hrefs containing any of these are skipped
CONTACT_SKIP = ["facebook", "linkedin", "twitter", "instagram", "youtube", "tiktok",
                "whatsapp", "mailto:", "tel:"]
# Contact-page link candidates: href substrings and anchor-text substrings
CONTACT_HREF_HINTS = ["contact", "Contact", "about-us", "hubungi"]
CONTACT_TEXT_HINTS = ["Contact", "Hubungi"]
# Accept a candidate when its lower-cased text / href has one of these
CONTACT_TEXT_ACCEPT = ["contact", "hubungi", "reach"]
CONTACT_HREF_ACCEPT = ["contact", "hubungi"]

# Chat-link hosts
CHAT_HINTS = ["wa.me", "whatsapp", "wasap"]

# Lead columns that a batch edit may write
EDITABLE_COLUMNS = ["name", "phone", "phone_type", "website", "website_phone",
                    "website_phone_type", "address", "category", "tags", "notes"]

# Import: file column spellings -> lead column
IMPORT_RENAMES = [("company", "name"), ("company_name", "name"), ("company name", "name"),
                  ("Company", "name"), ("Company Name", "name"), ("Phone", "phone"),
                  ("Website", "website"), ("Address", "address"),
                  ("Industry", "category"), ("Category", "category")]
# Cell texts that a spreadsheet reader takes as missing
MISSING_CELLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Free-text search columns
SEARCH_COLUMNS = ["name", "phone", "address", "category", "website", "tags", "notes"]
# Columns a view can show (default: all but notes)
VIEW_COLUMNS = ["name", "phone", "phone_type", "website_phone", "website_phone2",
                "website", "address", "category", "tags", "notes", "sources"]
VIEW_DEFAULT = ["name", "phone", "phone_type", "website_phone", "website_phone2",
                "website", "address", "category", "tags", "sources"]
# Export columns (default: the first nine)
EXPORT_COLUMNS = ["name", "phone", "phone_type", "website_phone", "website", "address",
                  "category", "company_size", "tags", "notes", "sources"]
EXPORT_DEFAULT_COUNT = 9
# Session detail view
SESSION_DETAIL_COLUMNS = ["name", "phone", "phone_type", "website", "address", "category"]

# Default tags (name, colour), seeded once into an empty tags table
DEFAULT_TAGS = [("已打電話", "#3B82F6"), ("有興趣", "#10B981"), ("不要再打", "#EF4444"),
                ("待跟進", "#F59E0B"), ("重要客戶", "#8B5CF6")]
DEFAULT_TAG_COLOR = "#6B7280"

# --- end of FIXED VALUES -------------------------------------------------
