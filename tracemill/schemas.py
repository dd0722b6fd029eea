"""Label orders, names, seeds and limits, and the row types of traces."""

from __future__ import annotations

# Fixed values.
ONTOLOGY = ["read", "search", "edit", "execute", "other_tool", "respond_or_finish"]
READ_NAMES = ["read", "read_file", "cat", "view", "open_file"]
SEARCH_NAMES = ["ls", "list", "glob", "grep", "find", "search", "search_files", "ripgrep"]
EDIT_NAMES = ["edit", "write", "write_file", "apply_patch", "patch", "replace"]
EXECUTE_NAMES = ["bash", "shell", "terminal", "exec", "execute", "execute_code", "run", "process"]
TOOLSET = ["patch", "process", "read_file", "search_files", "terminal", "write_file"]
SPLIT_SEED_3WAY = "trace2decision-i1-20260921"
SPLIT_SEED_4WAY = "20260920"
MAX_TASK_CHARS, MAX_SYSTEM_CHARS, MAX_MESSAGE_CHARS, MAX_HISTORY_CHARS = 6000, 2500, 4000, 14000
MAX_RENDERED_CHARS, ENVELOPE_TOKENS = 3500, 97
BUDGETS = (512, 640, 768, 1024)
FAILURE_LIKE = ['"success": false', "error", "failed", "not available"]
SUCCESS_LIKE = ['"success": true', '"status": "success"', 'exit_code": 0']
OBSERVATION_KEY = r"(?i)(?:^|_)(?:observation|result|output|response|stdout|stderr|exit_code|return_code)(?:$|_)"
RESPONSE_ID = r"^functions\.[^:]+:\d+$"
SECTIONS = ["TASK", "SYSTEM CONSTRAINTS", "AVAILABLE ACTIONS", "LATEST RELEVANT OBSERVATION", "RECENT HISTORY"]
TAGS = {"call": r"(?is)<tool_call\b[^>]*>(.*?)</tool_call\s*>", "response": r"(?is)<tool_response\b[^>]*>(.*?)</tool_response\s*>"}
THINK_TAG = r"(?i)<think\b[^>]*>|</think\s*>"
REASONING_MARKER = r"(?i)</?think\b|<\|(?:begin|end)_of_thought\|>|(?:^|\n)\s*(?:reasoning|analysis)\s*:"
REDACTED = r"(?i)(?:<redacted>|\[redacted\]|\*{3,}|REDACTED|sk-[A-Za-z0-9_*.-]+)"
OUTPUT_LIKE = r"(?i)(?:^|\n)(?:[\w./~-]+[$#>] |(?:stdout|stderr|exit code|output|result):|(?:error|warning|failed|passed|collected)\b)"

CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,reasoning_content:string,tool_calls:array<{CALL}>,tool_call_id:string,name:string>"
CUMULATIVE_ROW = f"task string, lang string, category string, split string, source_trajectory_sha256 string, assistant_step int, assistant_steps int, target_message_index int, n_messages int, messages array<{MESSAGE}>"
TAGGED_ROW = "id string, category string, subcategory string, task string, tools string, conversations array<struct<`from`:string,value:string>>"
