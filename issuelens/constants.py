"""Fixed values the results depend on.

FIXED VALUES: these must stay exactly as written (text, order, spelling,
trailing spaces) because prompts, URLs, triage and profile rules are defined by
them. They are listed plainly and in their natural order.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Instruction placed before every retrieval query (not before indexed text).
TASK_DESCRIPTION = (
    "Given a new Jira ticket summary, retrieve relevant historical tickets "
    "for triage classification"
)

# Allowed classes offered in the classification prompt: (name, description),
# in prompt order. An empty description prints the name alone.
ISSUE_TYPES = [
    ("Improvement", "An improvement or enhancement to an existing feature or task."),
    ("Task", "A task that needs to be done."),
    ("Sub-task", "The sub-task of the issue."),
    ("New Feature", "A new feature of the product, which has yet to be developed."),
    ("Bug", "A problem which impairs or prevents the functions of the product."),
    ("Epic", "Issue type for a big user story that needs to be broken down."),
    ("Test", "A new unit, integration or system test."),
    ("Wish", "General wishlist item."),
    ("New JIRA Project", "A request for a new JIRA project to be set up."),
    ("RTC", "An RTC request."),
    ("TCK Challenge", "Challenges made against the Sun Compatibility Test Suite."),
    ("Question", "A formal question. Initially added for the Legal JIRA."),
    ("Temp", ""),
    ("Brainstorming", "A place to record back and forth on notions not yet formed enough to make a 'New Feature' or 'Task'."),
    ("Umbrella", "An overarching type made of sub-tasks."),
    ("Story", "Issue type for a user story."),
    ("Technical task", "A technical task."),
    ("Dependency upgrade", "Upgrading a dependency to a newer version."),
    ("Suitable Name Search", "A search for a suitable name for an Apache product."),
    ("Documentation", "Documentation or Website."),
    ("Planned Work", "Assigned specifically to Contractors by the VP Infra or or other VP/ Board Member."),
    ("New Confluence Wiki", "A request for a new Confluence Wiki to be set up."),
    ("New Git Repo", ""),
    ("Github Integration", ""),
    ("New TLP ", ""),
    ("New TLP - Common Tasks", ""),
    ("SVN->GIT Migration", ""),
    ("Blog - New Blog Request", ""),
    ("Blogs - New Blog User Account Request", ""),
    ("Blogs - Access to Existing Blog", ""),
    ("New Bugzilla Project", ""),
    ("SVN->GIT Mirroring", ""),
    ("IT Help", "For general IT problems and questions. Created by JIRA Service Desk."),
    ("Access", "For new system accounts or passwords. Created by JIRA Service Desk."),
    ("Request", ""),
    ("Project", "Which project does this relate to?"),
    ("Proposal", ""),
    ("GitBox Request", ""),
    ("Dependency", "Issue is dependent on ..."),
    ("Requirement", ""),
    ("Comment", ""),
    ("Outage", "Pagerduty will use this to create tickets when an Incident occurs."),
    ("Office Hours", "Issues designed to be discussed during Office Hours meetings."),
    ("Pending Review", "Acknowledged but not planned work, or long range feature request in need of scoping and prioritization."),
    ("Board Vote", ""),
    ("Director Vote", ""),
    ("Technical Debt", ""),
]

# Prompt text pieces, in the order they appear in a prompt.
PROMPT_HEAD = (
    "Classify the following new Jira ticket by suggesting the most appropriate 'issuetype'.\n"
    "**New Ticket to Classify:**\n"
)
PROMPT_SUMMARY = "Summary: '{summary}'\n\n"
PROMPT_CONTEXT = "**Historical Context:**\n"
PROMPT_SIMILAR_INTRO = "Here are some historically similar tickets that might be relevant:\n"
PROMPT_SIMILAR_HEADER = "--- Similar Ticket {rank} (Key: {key}, Similarity: {similarity}) ---\n"
PROMPT_SIMILAR_TEXT = "Text: {text}\n"
PROMPT_SIMILAR_TYPE = "Original Issue Type: {issuetype}\n"
PROMPT_SIMILAR_END = "--- End of Similar Tickets ---\n\n"
PROMPT_NO_SIMILAR = "No similar historical tickets were found.\n\n"
PROMPT_CLASSES_HEAD = "**Possible Issue Types (choose only from this list):**\n"
PROMPT_TAIL = (
    "\n"
    "**Your Task:**\n"
    "1. Analyze the summary and context.\n"
    "2. Review the possible issue types above.\n"
    "3. Suggest the single most appropriate issuetype (from the list) and provide a brief reasoning.\n"
    "\n**Output Format:**\n"
    "Issuetype: <chosen type>\nReasoning: <your reasoning>\n"
)

# Evaluation sentinels for a query whose generator call failed.
PREDICTED_ON_FAILURE = "ERROR_QUERY_FAILED"
OUTPUT_ON_FAILURE = "ERROR: Query command failed or returned None"
UNKNOWN_LABEL = "Unknown"

# Custom field that holds the epic link, per tracker.
EPIC_FIELDS = {
    "Apache": "customfield_12311120",
    "Hyperledger": "customfield_10006",
    "IntelDAOS": "customfield_10092",
    "JFrog": "customfield_10806",
    "Jira": "customfield_12931",
    "JiraEcosystem": "customfield_12180",
    "MariaDB": "customfield_10600",
    "Mindville": "customfield_10000",
    "Mojang": "customfield_11602",
    "MongoDB": "customfield_10857",
    "Qt": "customfield_10400",
    "RedHat": "customfield_12311140",
    "Sakai": "customfield_10772",
    "SecondLife": "customfield_10871",
    "Sonatype": "customfield_11500",
    "Spring": "customfield_10680",
}

# Junk rows to skip among the earliest-created issues when finding the birth year.
BORN_SKIP = {"Apache": 289, "Jira": 1, "IntelDAOS": 1, "Qt": 7}
BORN_WINDOW = 500

# Trackers known to be unreachable.
INVALID_SOURCES = ["Mindville", "MariaDB"]

# Comment-request refusals that are skipped rather than treated as failures.
ACCEPTABLE_FAILURE_MESSAGES = [
    "Login Required",
    "Issue Does Not Exist",
    "Issue does not exist or you do not have permission to see it.",
]

# HTTP statuses that are retried.
RETRYABLE_STATUSES = [429, 500, 502, 503, 504]

# Request URL formats (base url, then query string).
SEARCH_URL = "{base}/rest/api/2/search?jql=&ORDER%20BY%20created%20ASC&startAt={start}&maxResults={size}&expand=changelog"
COMMENT_URL = "{base}/rest/api/2/issue/{key}/comment?orderBy=created&startAt={start}&maxResults={size}"
ISSUETYPE_URL = "{base}/rest/api/2/issuetype"
LINKTYPE_URL = "{base}/rest/api/2/issueLinkType"
FIELD_URL = "{base}/rest/api/2/field"

# Batch sizes of the reference jobs.
SEARCH_PAGE_SIZE = 250
COMMENT_PAGE_SIZE = 50
ENCODE_BATCH_SIZE = 256
TESTSET_SKIP = 900000
TESTSET_LIMIT = 10
TOP_K = 3
# ------------------------------------------------------------ END FIXED VALUES
