"""Word lists, label tables, weights and thresholds.

Everything in this module is data. The values have to equal the published
ones for the results to agree, so they are stated plainly and in their
natural order. All of them can be replaced through :mod:`reviewlens.config`.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Names (fixed values)
# ---------------------------------------------------------------------------
ASPECTS = (
    "Communication",
    "Subject Knowledge",
    "Engagement",
    "Responsiveness",
    "Assignment Quality",
)

SCORE_COLUMN = {
    "Communication": "communication_score",
    "Subject Knowledge": "subject_knowledge_score",
    "Engagement": "engagement_score",
    "Responsiveness": "responsiveness_score",
    "Assignment Quality": "assignment_quality_score",
}
SCORE_COLUMNS = tuple(SCORE_COLUMN[a] for a in ASPECTS)

SENTIMENTS = ("Positive", "Neutral", "Negative")

DEFAULT_ENTITY = "Unknown Teacher"
DEFAULT_SCORE = 5.0
DEFAULT_CONFIDENCE = 0.5

# ---------------------------------------------------------------------------
# Rule sentiment (fixed values)
# ---------------------------------------------------------------------------
POSITIVE_WORDS = (
    "great", "excellent", "best", "good", "amazing", "wonderful", "love", "liked", "engaging",
    "helpful", "supportive", "patience", "clear", "clarity", "structured", "professional",
    "punctual", "enthusiastic", "passionate", "interactive", "support", "fair", "real-world",
    "approachable", "encouraging", "informative", "inspiring", "organized", "knowledgeable",
    "patient", "friendly", "kind", "brilliant", "outstanding", "accessible",
    "concise", "articulate", "fairly", "prompt", "effectively", "recommend",
)

NEGATIVE_WORDS = (
    "difficult", "bad", "worst", "unclear", "fast", "slow", "boring", "late", "delayed",
    "unresponsive", "outdated", "monotonous", "poor", "chaotic", "unproductive", "unapproachable",
    "dismissive", "workload", "too many", "inconsistent", "vague", "disorganized", "unorganized",
    "confused", "dry", "rude", "harsh", "unfair", "frustrated", "frustrating", "mumble",
    "mumbling", "terrible", "waste", "useless", "ignore", "ignored", "ignores", "disappointed",
)

NEGATIONS = (
    "not", "no", "never", "neither", "nor", "hardly", "scarcely", "barely", "dont", "doesnt",
    "didnt", "wasnt", "werent", "havent", "hadnt", "couldnt", "wouldnt", "shouldnt", "cant",
    "cannot", "without",
)

INTENSIFIERS = (
    "very", "extremely", "really", "incredibly", "highly", "absolutely", "so", "super", "truly",
)

# Class-probability input: label spellings and the mixed threshold (fixed values)
PROBABILITY_LABELS = {
    "positive": "Positive", "POSITIVE": "Positive", "LABEL_2": "Positive",
    "negative": "Negative", "NEGATIVE": "Negative", "LABEL_0": "Negative",
    "neutral": "Neutral", "NEUTRAL": "Neutral", "LABEL_1": "Neutral",
}
MIXED_THRESHOLD = 0.20

# ---------------------------------------------------------------------------
# Aspects (fixed values)
# ---------------------------------------------------------------------------
ASPECT_KEYWORDS = {
    "Communication": (
        ("clear", "clarity", "explain", "structure", "organized", "pace", "simple", "analogy",
         "analogies", "articulate"),
        ("fast", "unclear", "vague", "mumble", "confusing", "confusion", "jargon", "speed",
         "rapid", "mumbling"),
    ),
    "Subject Knowledge": (
        ("knowledge", "expertise", "expert", "research", "industry", "theory", "competent",
         "factual", "academic", "deep"),
        ("outdated", "textbook", "error", "errors", "mistake", "mistakes", "unprepared",
         "inaccurate", "wrong"),
    ),
    "Engagement": (
        ("interactive", "fun", "engage", "engaging", "discussion", "quiz", "enthusiasm",
         "enthusiastic", "passionate", "participation", "participate", "motivate", "motivation"),
        ("boring", "monotonous", "sleep", "dry", "one-sided", "passive", "uninteresting",
         "lecture-only"),
    ),
    "Responsiveness": (
        ("responsive", "available", "office hours", "email", "reply", "helpful", "supportive",
         "approachable", "query", "queries", "support"),
        ("unresponsive", "late", "delayed", "ignore", "ignored", "dismissive", "unapproachable",
         "unavailable"),
    ),
    "Assignment Quality": (
        ("assignment", "assignments", "grading", "grade", "grades", "rubric", "feedback",
         "practical", "real-world", "exam", "exams"),
        ("excessive", "workload", "inconsistent", "delayed grades", "no feedback",
         "hard grading"),
    ),
}

DETECTOR_KEYWORDS = {
    "Communication": ("clear", "clarity", "explain", "structure", "pace", "mumble", "confusing",
                      "vague", "analogies", "articulate"),
    "Subject Knowledge": ("knowledge", "expertise", "expert", "research", "theory", "outdated",
                          "textbook", "error", "errors", "mistake"),
    "Engagement": ("interactive", "fun", "engage", "discussion", "quiz", "enthusiasm",
                   "passionate", "participation", "boring", "monotonous"),
    "Responsiveness": ("responsive", "available", "office hours", "email", "reply", "helpful",
                       "unresponsive", "late", "delayed"),
    "Assignment Quality": ("assignment", "assignments", "grading", "grade", "rubric", "workload",
                           "exams", "inconsistent"),
}
DETECT_TOP_K = 3
DETECT_THRESHOLD = 0.25

# Aspects counted by the mention table
DASHBOARD_ASPECTS = (
    "Teaching Style",
    "Communication",
    "Subject Knowledge",
    "Classroom Management",
    "Student Engagement",
    "Assessment & Feedback",
    "Punctuality & Professionalism",
    "Course Content",
)

RULE_DETECTED_THRESHOLD = 0.15
VECTOR_DETECTED_THRESHOLD = 0.28
TOP_SIMILARITIES = 3

# ---------------------------------------------------------------------------
# Scoring (fixed values)
# ---------------------------------------------------------------------------
REVIEW_WEIGHTS = {
    "Communication": 0.22,
    "Subject Knowledge": 0.25,
    "Engagement": 0.20,
    "Responsiveness": 0.18,
    "Assignment Quality": 0.15,
}
POLARITY_ALPHA = 0.40
INFER_STRENGTH_FROM = 6.5
INFER_IMPROVEMENT_BELOW = 5.0
MAX_LABELS = 5

ENTITY_WEIGHTS = {
    "Communication": 0.25,
    "Subject Knowledge": 0.25,
    "Engagement": 0.20,
    "Responsiveness": 0.15,
    "Assignment Quality": 0.15,
}
MIN_REVIEWS_HIGH = 10
MIN_REVIEWS_MEDIUM = 3
CONFIDENCE_HIGH = 0.75
CONFIDENCE_MEDIUM = 0.55

# (lower bound on the 0-10 scale, grade, descriptor); the 0-100 table is ten times it
GRADES = (
    (9.0, "A+", "Outstanding"),
    (8.0, "A", "Excellent"),
    (7.0, "B", "Good"),
    (6.0, "C", "Satisfactory"),
    (5.0, "D", "Needs Improvement"),
    (0.0, "F", "Poor"),
)

# ---------------------------------------------------------------------------
# Strength and improvement labels (fixed values)
# ---------------------------------------------------------------------------
STRENGTH_SIGNALS = {
    "clear explanations": (
        "clear", "clarity", "explains", "articulate", "concise", "simple",
        "well-structured", "understandable", "easy to follow",
    ),
    "deep subject knowledge": (
        "knowledge", "expertise", "mastery", "research", "scholar",
        "informed", "domain", "authority", "accurate",
    ),
    "high student engagement": (
        "engaging", "interactive", "participation", "enthusiastic",
        "dynamic", "fun", "energetic", "motivating", "interesting",
    ),
    "strong responsiveness": (
        "responsive", "available", "reply", "quick", "office hours",
        "support", "helpful", "feedback", "accessible", "attentive",
    ),
    "excellent assignment design": (
        "assignments", "rubric", "fair", "challenging", "relevant",
        "practical", "project", "well-designed", "structured",
    ),
    "effective communication": (
        "communicates", "speaks", "language", "tone", "articulation",
        "narrates", "explains", "pace", "diction",
    ),
    "professional and punctual": (
        "punctual", "professional", "respectful", "dedicated",
        "committed", "on time", "responsible",
    ),
}

IMPROVEMENT_SIGNALS = {
    "assignment workload": (
        "excessive", "workload", "overloaded", "too much", "overwhelming",
        "tight deadline", "unrealistic", "heavy",
    ),
    "lecture clarity": (
        "unclear", "confusing", "hard to follow", "jumps", "disjointed",
        "vague", "mumbles", "fast",
    ),
    "student interaction": (
        "no interaction", "one-sided", "boring", "passive", "monotonous",
        "no participation", "disengaged", "dull",
    ),
    "feedback quality": (
        "generic feedback", "no feedback", "late marks", "vague feedback",
        "one-word", "no model answers", "inconsistent grading",
    ),
    "responsiveness": (
        "delayed", "slow reply", "unavailable", "ignores",
        "dismisses", "not accessible", "no office hours",
    ),
    "subject depth": (
        "outdated", "inaccurate", "errors", "wrong", "limited knowledge",
        "reads notes", "textbook only", "shallow",
    ),
    "classroom energy": (
        "lifeless", "unenthusiastic", "demoralizing", "tense",
        "unwelcoming", "no energy", "disinterested",
    ),
}

STRENGTH_PHRASES = (
    ("clear", "clear explanations"),
    ("clarity", "clear explanations"),
    ("explains well", "clear explanations"),
    ("articulate", "articulate communication"),
    ("well-structured", "well-structured lectures"),
    ("engaging", "highly engaging teaching style"),
    ("interactive", "interactive classroom sessions"),
    ("enthusiastic", "enthusiastic and passionate delivery"),
    ("knowledgeable", "deep subject knowledge"),
    ("expertise", "strong subject expertise"),
    ("research", "research-backed content"),
    ("responsive", "excellent student responsiveness"),
    ("available", "high availability for students"),
    ("helpful", "helpful and supportive approach"),
    ("office hours", "consistent office hours"),
    ("fair grading", "fair and transparent grading"),
    ("rubric", "clear assignment rubrics"),
    ("practical", "use of practical real-world examples"),
    ("real-world", "application of real-world context"),
    ("punctual", "punctuality and professionalism"),
    ("professional", "high professionalism"),
    ("motivating", "motivating and inspiring"),
    ("encourages", "encourages student participation"),
)

IMPROVEMENT_PHRASES = (
    ("unclear", "improve explanation clarity"),
    ("confusing", "improve explanation clarity"),
    ("fast", "reduce lecture pace"),
    ("too fast", "reduce lecture pace"),
    ("mumble", "improve speech clarity"),
    ("vague", "provide clearer instructions"),
    ("late", "improve punctuality and responsiveness"),
    ("delayed", "improve response time"),
    ("unresponsive", "improve response time"),
    ("boring", "increase classroom engagement"),
    ("monotonous", "vary teaching methods"),
    ("one-sided", "encourage more student interaction"),
    ("outdated", "update course content"),
    ("inaccurate", "verify factual accuracy"),
    ("errors", "verify factual accuracy"),
    ("excessive workload", "balance assignment workload"),
    ("too many assignments", "balance assignment workload"),
    ("grading", "improve grading consistency"),
    ("inconsistent", "improve grading consistency"),
    ("generic feedback", "provide more specific assignment feedback"),
    ("no feedback", "provide more specific assignment feedback"),
    ("no model answers", "share model answers post-submission"),
    ("disconnected", "align assignments with lecture content"),
)

STRENGTH_ASPECT = {
    "clear explanations": "Communication",
    "articulate communication": "Communication",
    "well-structured lectures": "Communication",
    "highly engaging teaching style": "Engagement",
    "interactive classroom sessions": "Engagement",
    "enthusiastic and passionate delivery": "Engagement",
    "encourages student participation": "Engagement",
    "deep subject knowledge": "Subject Knowledge",
    "strong subject expertise": "Subject Knowledge",
    "research-backed content": "Subject Knowledge",
    "excellent student responsiveness": "Responsiveness",
    "high availability for students": "Responsiveness",
    "helpful and supportive approach": "Responsiveness",
    "consistent office hours": "Responsiveness",
    "fair and transparent grading": "Assignment Quality",
    "clear assignment rubrics": "Assignment Quality",
    "use of practical real-world examples": "Assignment Quality",
    "application of real-world context": "Assignment Quality",
    "punctuality and professionalism": "Responsiveness",
    "high professionalism": "Responsiveness",
    "motivating and inspiring": "Engagement",
}

IMPROVEMENT_ASPECT = {
    "improve explanation clarity": "Communication",
    "reduce lecture pace": "Communication",
    "improve speech clarity": "Communication",
    "provide clearer instructions": "Communication",
    "improve punctuality and responsiveness": "Responsiveness",
    "improve response time": "Responsiveness",
    "increase classroom engagement": "Engagement",
    "vary teaching methods": "Engagement",
    "encourage more student interaction": "Engagement",
    "update course content": "Subject Knowledge",
    "verify factual accuracy": "Subject Knowledge",
    "balance assignment workload": "Assignment Quality",
    "improve grading consistency": "Assignment Quality",
    "provide more specific assignment feedback": "Assignment Quality",
    "share model answers post-submission": "Assignment Quality",
    "align assignments with lecture content": "Assignment Quality",
}

# ---------------------------------------------------------------------------
# Summaries and keywords (fixed values)
# ---------------------------------------------------------------------------
SENTENCE_KEYWORDS = {
    "Communication": ("explain", "clear", "clarity", "lecture", "speak", "pace", "fast",
                      "understand"),
    "Subject Knowledge": ("knowledge", "expert", "research", "accurate", "mistake", "error",
                          "subject"),
    "Engagement": ("engage", "interactive", "fun", "enthusias", "participat", "interest",
                   "boring"),
    "Responsiveness": ("responsive", "reply", "email", "office hours", "available", "help",
                       "support"),
    "Assignment Quality": ("assignment", "grading", "grade", "rubric", "workload", "deadline",
                           "exam"),
}

STOP_WORDS = (
    "the", "a", "an", "is", "in", "it", "of", "and", "to", "for",
    "that", "this", "was", "are", "be", "as", "at", "by", "we",
    "he", "she", "his", "her", "they", "them", "with", "from",
    "has", "have", "had", "not", "but", "or", "on", "so", "very",
    "my", "our", "your", "also", "more", "i", "me", "you", "can",
    "does", "do", "did", "will", "would", "could", "should", "been",
    "teacher", "professor", "class", "course", "student", "students",
    "always", "never", "every", "often", "sometimes", "which",
)

NO_FEEDBACK_MESSAGE = "No feedback available for summarisation."
NO_COMMENTS_MESSAGE = "No feedback comments available."
SUMMARY_DISABLED_MESSAGE = "Summarization disabled."
SUMMARY_OPENING_CHARS = 300
SUMMARY_MIN_WORDS = 25

# ---------------------------------------------------------------------------
# Ingest (fixed values)
# ---------------------------------------------------------------------------
COLUMN_ALIASES = {
    "feedback_text": (
        "feedback", "comment", "comments", "review", "reviews",
        "text", "feedback_text", "student_feedback", "response",
        "review_text", "review text", "feedback text", "comments_text",
        "comments text", "comment_text", "comment text", "response_text",
        "response text", "reviews_text", "reviews text", "student_comment",
        "student_comments", "student_review", "student_reviews", "evaluation",
        "evaluations",
    ),
    "teacher_name": (
        "teacher", "teacher_name", "instructor", "professor",
        "faculty", "lecturer", "name", "teacher name", "instructor name",
        "professor name", "faculty name", "lecturer name", "staff name",
        "staff", "educator", "educator name",
    ),
    "date": (
        "date", "submission_date", "created_at", "timestamp", "submitted_on",
        "submission date", "submitted date", "date submitted", "created date",
        "time", "datetime",
    ),
    "subject": (
        "subject", "course", "class", "module", "department", "subject name",
        "course name", "class name", "module name", "course code", "course_code",
    ),
    "rating": (
        "rating", "score", "stars", "grade_given", "marks", "overall_rating",
        "overall rating", "teacher rating", "teacher_rating", "rating score",
        "score rating", "stars rating",
    ),
}

SAMPLE_ENTITIES = (
    ("Dr. Aisha Khan", "Mathematics"),
    ("Prof. Ravi Sharma", "Physics"),
    ("Ms. Priya Nair", "Computer Science"),
    ("Mr. James Okafor", "English Literature"),
    ("Dr. Emily Chen", "Chemistry"),
)

SAMPLE_POSITIVE = (
    "An exceptional teacher who explains concepts with remarkable clarity and patience.",
    "Very engaging and knowledgeable. Makes even difficult topics easy to understand.",
    "Always available for doubt-clearing sessions. Truly passionate about teaching.",
    "The best teacher I've had. Innovative teaching methods and great communication skills.",
    "Provides excellent real-world examples and keeps the class very interactive.",
    "Highly professional and punctual. Course content is well-structured and relevant.",
    "Great at making students feel comfortable to ask questions. Very supportive.",
    "Thoroughly prepares lessons and gives constructive feedback on assignments.",
    "Dynamic and enthusiastic. Classes are never boring, always something new to learn.",
    "Subject knowledge is outstanding. Explains the 'why' behind every concept.",
)
SAMPLE_NEUTRAL = (
    "The teacher covers the syllabus adequately. Could use more practical examples.",
    "Teaching is satisfactory. Some topics could be explained in more depth.",
    "Classes are on time and content is standard. Nothing exceptional but no issues.",
    "Good knowledge of the subject but needs to improve student interaction.",
    "Assignments are fair. The teaching pace is sometimes too fast.",
    "Average experience. The teacher is available but not very proactive.",
    "Lectures are informative but could be more engaging for students.",
    "The course content is relevant though the delivery can be monotonous at times.",
)
SAMPLE_NEGATIVE = (
    "Very difficult to understand due to fast speaking pace and unclear explanations.",
    "Often arrives late to class which is very disrespectful of students' time.",
    "The feedback on assignments is vague and not helpful for improvement.",
    "Does not engage with students. Lectures are one-sided and boring.",
    "Limited knowledge beyond the textbook. Cannot answer deeper questions.",
    "Very poor classroom management. Class is frequently chaotic and unproductive.",
    "Course content feels outdated and not aligned with current industry standards.",
    "The teacher is unapproachable and dismissive when students ask for help.",
)
# pool, share in the mix, rating band
SAMPLE_POOLS = (
    (SAMPLE_POSITIVE, 5, 3.5, 5.0),
    (SAMPLE_NEUTRAL, 3, 2.5, 3.5),
    (SAMPLE_NEGATIVE, 2, 1.0, 2.5),
)

# Joining patterns of the corpus generator for mixed reviews, and its class shares
MIXED_PATTERNS = (
    "{pos} However, {neg}",
    "{pos} On the downside, {neg}",
    "{neg} That said, {pos}",
    "{neg} Despite this, {pos}",
    "{pos} Nevertheless, {neg}",
    "{neg} To give credit where it is due, {pos}",
    "{pos} One area needing improvement: {neg}",
    "{pos} With that in mind, {neg}",
)
CORPUS_SHARES = (("pos", 45), ("neg", 30), ("neu", 15), ("mix", 10))
