"""Fixed values that right results need: word lists, suffixes, thresholds and message texts, as plain text."""

# Stop words that never count as tokens (fixed values).
STOP = (
    "the a an is are of to in and or what who how why when where which does do for on with this that "
    "को का की मा लाई ले हो छ के कसरी कहिले कहाँ र वा यो त्यो भएको गर्ने"
).split()

# Words without a topic (fixed values).
GENERIC = (
    "tell me about explain describe information info details detail more something anything everything this that it "
    "these those document documents file files give show please can you i want know say write there any some all main "
    "topic content बारे बारेमा जानकारी विवरण बताउनु बताउनुहोस् भन्नुहोस् सबै केही यसको यसका यसमा कागजात फाइल मुख्य विषय देऊ "
    "दिनुहोस् बुझाउनुहोस्"
).split()

# Words that name a kind of item (fixed values).
IMAGE_WORDS = (
    "image images figure figures fig chart charts diagram diagrams picture photo graph plot illustration चित्र तस्बिर ग्राफ नक्सा"
).split()
TABLE_WORDS = "table tables tabular तालिका तालिकामा".split()
EQUATION_WORDS = "equation equations formula formulas formulae सूत्र समीकरण".split()
KIND_FILLER = [*IMAGE_WORDS, *TABLE_WORDS, *EQUATION_WORDS, "show", "shows", "shown", "see"]

# Words that ask for a summary (fixed values).
SUMMARY = "summarize summarise summary overview gist सारांश संक्षेप सार".split()

# Devanagari endings in the order in which they are tried (fixed values).
SUFFIXES = "हरूको हरूले हरूमा हरू बाट सँग प्रति लाई मा को का की ले मै".split()

DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"

# Limits and thresholds (fixed values).
CHUNK_CHARS, CHUNK_OVERLAP, SHORTEST_CHUNK = 700, 120, 10
ENTITIES_PER_ITEM, TOO_COMMON, NEIGHBOURS = 8, 0.4, 8
RRF, CANDIDATES, ANCHORS = 60, 50, 3
DENSE_WEIGHT, WORD_WEIGHT = 0.8, 0.2
Z_STRONG, Z_LEAST, Z_ALONE = 3.0, 1.5, 4.0
COVER_GOOD, COVER_SOME, SMALL_CORPUS = 0.5, 0.2, 10
AMBIGUOUS_RATIO, AMBIGUOUS_TERMS, OPTIONS = 0.8, 2, 4
FEW_DOCUMENTS, LISTED_DOCUMENTS, SUMMARY_LINES = 3, 8, 6
TABLE_ROWS = 8
CONTEXT_CHARS = 300

# What is said when a question isn't answered from the documents, in English and Nepali (fixed values).
MESSAGES = {
    "generic": {
        "en": "Your question is a bit broad, so I can't give a precise answer. What exactly would you like to know? You can pick a topic below or type a more specific question.",
        "ne": "तपाईंको प्रश्न धेरै सामान्य छ, त्यसैले सही जवाफ दिन सकिँदैन। तपाईं ठ्याक्कै के जान्न चाहनुहुन्छ? तल विषय छान्नुहोस् वा थप स्पष्ट प्रश्न लेख्नुहोस्।",
    },
    "ambiguous": {
        "en": "Your question matches several different parts of your documents. Which one do you mean?",
        "ne": "तपाईंको प्रश्न कागजातका धेरै फरक भागसँग मिल्छ। तपाईंले कुन बुझ्नुभएको हो?",
    },
    "summary": {
        "en": "Which document would you like me to summarize?",
        "ne": "कुन कागजातको सारांश चाहिन्छ?",
    },
    "not_found": {
        "en": "I couldn't find an answer to that in your documents. Try rephrasing, or pick a topic they cover:",
        "ne": "तपाईंका कागजातहरूमा यस प्रश्नको जवाफ फेला परेन। फरक तरिकाले सोध्नुहोस्, वा कागजातमा भएको विषय छान्नुहोस्:",
    },
    "no_documents": {
        "en": "No matching documents.",
        "ne": "No matching documents.",
    },
}
SUMMARY_TITLE = {"en": "Main points of", "ne": "मुख्य बुँदाहरू:"}
