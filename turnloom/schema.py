"""Record types.  One superset of meta fields; absent ones are null and left out by the JSON writer."""

TURN = "struct<role:string,content:string>"
TURNS = f"array<{TURN}>"
META = "struct<intent:string,pattern:string,group:string,domain:string,rationale:string,context_required:boolean,user_turns:int,total_turns:int,messages:int,source:string,augmented:boolean>"
MESSAGES_RECORD = f"messages {TURNS}, meta {META}"
CONVERSATIONS_RECORD = f"conversations array<struct<from:string,value:string>>, meta {META}"
SAMPLE = f"turns {TURNS}, rewrite string, domain string, rationale string, pattern string, intent string, context_required boolean, user_turns int, total_turns int"
PREDICTION = f"meta {META}, gold string, pred string, score int, reason string"
COMPARISON = f"dialogue {TURNS}, gold string, base_output string, finetuned_output string, meta {META}"

#: What the last user turn and the answer are marked with.
TAG = "<REWRITE>\n"
SYSTEM_PROMPT = "Rewrite the last user turn as a request that stands alone."
PATTERNS = ("multi_turn_slot", "pronoun_resolution", "correction", "code_switching", "implicit_reference", "compound_intent", "negation", "irrelevant_context")
