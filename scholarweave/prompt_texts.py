"""Prompt texts per language, question type and complexity."""

# Base instructions.
BASE = {
    "ko": {
        "system_role": "당신은 과학 논문과 연구 데이터를 분석하는 전문 AI 어시스턴트입니다.",
        "task_description": "제공된 지식 그래프 정보를 바탕으로 사용자의 질문에 정확하고 유용한 답변을 제공해주세요.",
        "context_explanation": "다음은 질문과 관련된 논문, 저자, 키워드, 저널 정보가 포함된 지식 그래프 컨텍스트입니다:",
        "answer_guidelines": [
            "제공된 컨텍스트 정보를 기반으로 답변하세요", "구체적인 논문 제목, 저자명, 연도 등을 포함하여 답변하세요",
            "불확실한 정보는 추측하지 말고 알 수 없다고 명시하세요", "관련성이 높은 정보를 우선적으로 활용하세요",
        ],
        "citation_instruction": "답변에는 관련 논문이나 저자를 구체적으로 언급해주세요.",
    },
    "en": {
        "system_role": "You are an expert AI assistant specialized in analyzing scientific papers and research data.",
        "task_description": "Please provide accurate and helpful answers to user questions based on the provided knowledge graph information.",
        "context_explanation": "The following is knowledge graph context containing papers, authors, keywords, and journal information related to the question:",
        "answer_guidelines": [
            "Base your answer on the provided context information", "Include specific paper titles, author names, years, etc. in your response",
            "If information is uncertain, explicitly state that it's unknown rather than guessing", "Prioritize highly relevant information",
        ],
        "citation_instruction": "Please specifically mention relevant papers or authors in your answer.",
    },
    "mixed": {
        "system_role": "You are an expert AI assistant specialized in analyzing scientific papers and research data. 당신은 과학 논문과 연구 데이터 분석을 전문으로 하는 AI 어시스턴트입니다.",
        "task_description": "Please provide accurate and helpful answers based on the knowledge graph information. 지식 그래프 정보를 바탕으로 정확하고 유용한 답변을 제공해주세요.",
        "context_explanation": "다음은 질문과 관련된 지식 그래프 컨텍스트입니다 (The following is knowledge graph context related to the question):",
        "answer_guidelines": [
            "제공된 컨텍스트 정보를 기반으로 답변하세요 (Base your answer on the provided context)",
            "구체적인 논문 제목, 저자명을 포함하세요 (Include specific paper titles and author names)",
            "불확실한 정보는 명시하세요 (Explicitly state uncertain information)", "관련성 높은 정보를 우선하세요 (Prioritize highly relevant information)",
        ],
        "citation_instruction": "관련 논문이나 저자를 구체적으로 언급해주세요 (Please mention relevant papers or authors specifically).",
    },
}
# Fixed values: (instruction, focus areas, output format) per question type.
BY_TYPE = {
    "citation_analysis": {
        "ko": ("인용 관계와 영향력을 중심으로 분석해주세요.", ["피인용 수", "인용 패턴", "영향력 있는 논문", "연구 영향도"], "인용 분석 결과를 구체적인 수치와 함께 제시해주세요."),
        "en": ("Focus on citation relationships and impact analysis.", ["Citation counts", "Citation patterns", "Influential papers", "Research impact"], "Present citation analysis results with specific metrics."),
    },
    "author_analysis": {
        "ko": ("연구자의 연구 분야, 협업 네트워크, 연구 생산성을 분석해주세요.", ["주요 연구 분야", "공동 연구자", "논문 수", "연구 활동 기간"], "연구자별로 구분하여 상세한 프로필을 제공해주세요."),
        "en": ("Analyze researchers' fields, collaboration networks, and productivity.", ["Research areas", "Collaborators", "Publication count", "Research period"], "Provide detailed profiles for each researcher."),
    },
    "keyword_analysis": {
        "ko": ("키워드와 연구 주제의 관계를 분석해주세요.", ["키워드 빈도", "관련 주제", "연구 트렌드", "주제 연관성"], "키워드별 사용 빈도와 관련 연구를 정리해주세요."),
        "en": ("Analyze relationships between keywords and research topics.", ["Keyword frequency", "Related topics", "Research trends", "Topic associations"], "Organize keyword frequencies and related research."),
    },
    "trend_analysis": {
        "ko": ("시간의 흐름에 따른 연구 동향과 변화를 분석해주세요.", ["연도별 연구량", "주제 변화", "새로운 트렌드", "기술 발전"], "시간순으로 정리하여 트렌드 변화를 명확히 보여주세요."),
        "en": ("Analyze research trends and changes over time.", ["Research volume by year", "Topic evolution", "Emerging trends", "Technology development"], "Present trend changes clearly in chronological order."),
    },
    "collaboration_analysis": {
        "ko": ("연구자 간 협업 관계와 네트워크를 분석해주세요.", ["공동 연구", "협업 빈도", "연구 네트워크", "기관 간 협력"], "협업 관계를 네트워크 형태로 설명해주세요."),
        "en": ("Analyze collaboration relationships and networks among researchers.", ["Joint research", "Collaboration frequency", "Research networks", "Institutional cooperation"], "Explain collaboration relationships in network format."),
    },
    "comprehensive_analysis": {
        "ko": ("다양한 관점에서 종합적으로 분석해주세요.", ["전체적 개요", "주요 연구자", "핵심 논문", "연구 동향", "향후 방향"], "섹션별로 구분하여 체계적으로 분석 결과를 제시해주세요."),
        "en": ("Provide comprehensive analysis from multiple perspectives.", ["Overall overview", "Key researchers", "Core papers", "Research trends", "Future directions"], "Present analysis results systematically by sections."),
    },
    "factual_lookup": {
        "ko": ("요청된 정보를 정확하고 간단명료하게 제공해주세요.", ["정확한 정보", "구체적 데이터", "명확한 답변"], "질문에 대한 직접적인 답변을 제공해주세요."),
        "en": ("Provide the requested information accurately and concisely.", ["Accurate information", "Specific data", "Clear answers"], "Provide direct answers to the question."),
    },
}
# Fixed values: (approach, detail level, structure) per complexity.
BY_COMPLEXITY = {
    "simple": {"ko": ("간단명료한 답변", "핵심 정보만 포함", "단답형 또는 짧은 설명"), "en": ("Simple and clear answer", "Include only key information", "Short answer or brief explanation")},
    "medium": {"ko": ("적절한 수준의 상세 분석", "주요 내용과 배경 정보 포함", "구조화된 설명 (2-3개 섹션)"), "en": ("Moderately detailed analysis", "Include main content and background", "Structured explanation (2-3 sections)")},
    "complex": {"ko": ("심층적이고 종합적인 분석", "다양한 관점과 세부 정보 포함", "체계적인 다중 섹션 구성"), "en": ("In-depth and comprehensive analysis", "Include multiple perspectives and details", "Systematic multi-section organization")},
    "exploratory": {"ko": ("탐색적이고 창의적인 분석", "숨겨진 패턴과 새로운 인사이트 발굴", "발견적 접근법으로 다각도 분석"), "en": ("Exploratory and creative analysis", "Discover hidden patterns and new insights", "Multi-angle analysis with discovery approach")},
}
# Frame of the direct question prompt.
QA_HEAD = "다음은 학술 연구 문헌 분석 시스템입니다. 제공된 컨텍스트를 바탕으로 사용자의 질문에 정확하고 유용한 답변을 제공하세요.\n\n    **컨텍스트:**\n    "
QA_QUESTION = "\n\n    **질문:** "
QA_TAIL = """

    **답변 가이드라인:**
    1. 컨텍스트에 기반하여 정확한 정보를 제공하세요
    2. 한국어와 영어를 적절히 혼용하여 답변하세요
    3. 구체적인 논문, 저자, 연구 결과를 언급하세요
    4. 불확실한 내용은 명시하세요
    5. 답변은 500자 이내로 간결하게 작성하세요

    **답변:**"""
# Answers given when generation fails.
NO_ANSWER = "죄송합니다. 응답을 생성할 수 없었습니다."
NO_GOOD_ANSWER = "죄송합니다. 적절한 답변을 생성할 수 없었습니다. 질문을 다시 표현해 주시겠어요?"
FALLBACKS = {
    "memory": "죄송합니다. 현재 시스템 리소스가 부족하여 응답을 생성할 수 없습니다.\n질문을 더 구체적이고 간단하게 바꿔서 다시 시도해주세요.",
    "timeout": "죄송합니다. 응답 생성 시간이 초과되었습니다.\n질문을 더 구체적으로 바꿔서 다시 시도해주세요.",
}
FALLBACK_OTHER = "죄송합니다. 현재 응답을 생성할 수 없습니다.\n잠시 후 다시 시도해주시거나, 질문을 다시 표현해 주세요."
