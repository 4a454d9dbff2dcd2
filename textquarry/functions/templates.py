'''Prompt and training-text templates.

Fixed values: models are trained and asked with exactly these texts, so they are stated as they
are. ``{name}`` marks a field, doubled braces stand for one brace.
'''

QA_GENERATION = """\
You are a legal question-answer pair generator for Australian law.

Given the following excerpt from an Australian legal document, generate {n} question-answer pairs that test comprehension of the legal content.

Rules:
- Questions must be answerable solely from the provided text.
- Answers must be accurate, concise, and directly grounded in the text.
- Do NOT invent facts not present in the text.
- Output ONLY a JSON array, no other text.

Format:
[
  {{"question": "...", "answer": "..."}},
  {{"question": "...", "answer": "..."}}
]

LEGAL TEXT:
{text}

JSON OUTPUT:
"""

TRAINING_QA = """\
Below is a question about Australian law. Write a response that accurately and concisely answers it.

### Instruction:
You are an expert Australian legal assistant trained on the Open Australian Legal Corpus. Answer the following question accurately, citing relevant legislation or case law where appropriate.

### Input:
{question}

### Response:
{answer}"""

TRAINING_DOCUMENT = """\
Below is an instruction that describes a legal task, paired with an input that provides further context. Write a response that appropriately completes the request.

### Instruction:
Analyze the following Australian legal document. Synthesize its legal principles based on the provided jurisdiction and context framework.

### Input:
Citation: {citation}
Jurisdiction: {jurisdiction}
Document Type: {type}

### Response:
{text}"""

CLOSED_BOOK = """\
Below is an instruction that describes a legal task. Write a response that appropriately completes the request.

### Instruction:
You are an expert Australian legal assistant trained on the Open Australian Legal Corpus. Answer the following question accurately, citing relevant legislation or case law where appropriate.

### Input:
{question}

### Response:
"""

OPEN_BOOK = """\
You are a specialized Australian Legal Research Assistant.
Your task is to answer the user's question using ONLY the provided Legal Context.

CRITICAL CONSTRAINTS:
1. If the provided context does not contain the answer, you MUST state: "I cannot find the answer in the provided context."
2. DO NOT use your own external knowledge or training data to fill in gaps.
3. If the context is incomplete or nonsensical, do not attempt to fabricate information.
4. If you identify a list of sections or provisions in the context that do not answer the question, do not repeat them.
5. Keep your answer concise and strictly grounded in the text provided.

LEGAL CONTEXT:
{context}

QUESTION:
{question}

ANSWER:
"""

SHORT = """\
Below is an instruction that describes a legal task. Write a response that appropriately completes the request.

### Instruction:
You are an expert Australian legal assistant. Answer the following question accurately.

### Input:
{question}

### Response:
"""

CHAT_SYSTEM = """\
You are an expert Australian legal assistant. You have been fine-tuned on the Open Australian Legal Corpus, which includes legislation, case law, and legal instruments across all Australian jurisdictions.

When responding:
- Cite relevant Australian legislation, regulations, or case law where applicable.
- Specify the jurisdiction (Commonwealth, NSW, VIC, QLD, WA, SA, TAS, ACT, NT) when relevant.
- Clarify when a matter requires professional legal advice.
- Be precise and use proper legal terminology."""

CHAT = """\
Below is an instruction that describes a legal task. Write a response that appropriately completes the request.

### Instruction:
{system}

### Previous conversation:{history}

### Current question:
{question}

### Response:
"""

ROUND_REVIEW = """\
You are an expert machine learning engineer helping to optimise hyperparameters for a LLaMA LoRA fine-tuning run on Australian legal text using Unsloth on a Windows machine with an RTX 3070 (8GB VRAM).

TRAINING SUMMARY — Round {round}
======================================
Current config:
{config}

Loss curve this round:
{losses}

Previous rounds:
{history}
{answers}

TASK
====
Analyse the loss curve and the sample answers above. Consider both whether the loss is decreasing AND whether the answers look factually grounded and coherent. If answers are repetitive or hallucinating, suggest a higher repetition penalty or lower learning rate. If the loss is still decreasing steeply, suggest continuing with similar settings.

Respond with ONLY a JSON object containing the keys you want to change from the current config. Only include keys that need changing. Use these exact key names:
- learning_rate (float, range 1e-6 to 1e-3)
- per_device_train_batch_size (int, 1-4)
- gradient_accumulation_steps (int, 1-32)
- warmup_steps (int, 0-200)
- weight_decay (float, 0.0-0.3)
- r (int, LoRA rank, 4-64)
- lora_alpha (int, 4-128)

If no changes are needed, return: {{}}

Respond with ONLY the JSON object, no explanation, no markdown fences.
"""

# Heading of the sampled answers inside ROUND_REVIEW.
ANSWERS_HEADING = "\n20 representative benchmark answers (every 5th question, answers capped at 600 chars):\n"
NO_ROUNDS = "  (no previous rounds)"
NO_HISTORY = " (none)"
