"""What is known of each format: what conversion keeps and loses, advice after a failure, and style options by policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What conversion keeps and loses, by extension.
SUMMARIES = {
    "md": ("제목, 문단, 목록, 표, 코드블록, 클릭 가능한 본문 링크, PNG/JPEG/GIF/BMP/WebP 이미지, GFM 각주, YAML frontmatter 제목", "상대경로·접근 차단 이미지의 실제 그림, 표 안 링크 기능, 복잡한 HTML, 사용자 정의 스타일, 페이지 배치"),
    "markdown": ("제목, 문단, 목록, 표, 코드블록, 클릭 가능한 본문 링크, PNG/JPEG/GIF/BMP/WebP 이미지, GFM 각주, YAML frontmatter 제목", "상대경로·접근 차단 이미지의 실제 그림, 표 안 링크 기능, 복잡한 HTML, 사용자 정의 스타일, 페이지 배치"),
    "html": ("h1-h6, p, 중첩 ul/ol, 병합 표, strong/em/u/s, 일부 글자색과 태그 없는 일반 텍스트, 원본 우선 서식 정책", "웹 화면 배치, CSS 레이아웃, 이미지, SVG, 스크립트, 외부 리소스"),
    "htm": ("h1-h6, p, ul/ol, table, strong/em 중심 구조", "CSS 레이아웃, 이미지, SVG, 스크립트, 외부 리소스"),
    "docx": ("본문, 제목, 번호·글머리 목록, 기본 표, 하이퍼링크, 인라인 서식·색상·이미지, 각주, 주석(각주 형태), 원본 우선 서식 정책", "Word 페이지 배치·테마, WMF/EMF 실제 그림, 변경 추적, 복잡한 개체"),
    "pptx": ("슬라이드 순서, 제목·본문 텍스트, 글머리 목록, 슬라이드 안 표(병합 포함), 그림, 그룹 도형 내부 콘텐츠, 발표자 노트", "슬라이드 레이아웃·디자인·애니메이션, 도형 위치(텍스트 상자 외)"),
    "txt": ("원문 텍스트, 줄바꿈, 빈 줄 기준 문단", "제목 구조, 표 구조, 굵게/색상 같은 서식 정보"),
    "text": ("원문 텍스트, 줄바꿈, 빈 줄 기준 문단", "제목 구조, 표 구조, 굵게/색상 같은 서식 정보"),
    "csv": ("CSV·탭 구분 표의 행/열, 빈 셀, 첫 행 머리글, 긴 텍스트", "셀 병합, 수식 자체, 색상, 차트, 이미지, 여러 시트"),
    "xlsx": ("첫 번째 시트의 행/열, 빈 셀, 첫 행 머리글, 원본 우선 서식 정책", "여러 시트, 수식 자체, 차트, 이미지, 일부 셀 병합과 세부 서식"),
    "xls": ("첫 번째 시트의 행/열, 빈 셀, 첫 행 머리글", "여러 시트, 수식 자체, 차트, 이미지, 셀 병합과 세부 서식"),
    "json": ("객체/배열 값, 키-값 표, 객체 배열의 행형 표, 정규화된 IR", "보고서형 레이아웃, 데이터 타입 의미, 원본 들여쓰기"),
    "ipynb": ("마크다운 셀, 코드 셀, 텍스트 출력, 코드 셀 이미지 출력(PNG/JPEG)", "실행 상태, 차트 라이브러리 위젯 출력, LaTeX 수식, 메타데이터"),
    "hwp": ("HWPX 오업로드 시 XML 텍스트와 일부 표", "HWP5 본문, 이미지, 개체, 복잡한 한글 서식"),
    "hwpx": ("이미 HWPX이므로 원본 사용 권장, 필요 시 텍스트 일부 재구성", "재변환 시 원본 스타일, 이미지, 개체, 세밀한 레이아웃"),
}
OTHER_SUMMARY = ("텍스트 중심 구조", "이미지, 복잡한 서식, 외부 리소스, 정교한 레이아웃")
# What to try after a failure, by extension.
ADVICE = {
    "docx": "Word에서 파일을 다시 저장한 뒤 시도하세요. 표·이미지가 복잡하면 DOCX를 단순화하거나 한컴에서 직접 HWPX로 저장해 보세요.",
    "hwp": "HWP는 베타 입력입니다. 한컴 공식 HwpxConverter로 HWPX로 먼저 변환하거나, 한컴오피스에서 HWPX/DOCX로 다시 저장한 파일을 사용하면 성공 가능성이 높습니다.",
    "hwpx": "이미 HWPX인 파일은 변환보다 원본 사용을 권장합니다. 복구가 목적이면 한컴에서 열리는지 먼저 확인하세요.",
    "json": "JSON 문법 오류가 없는지 확인하고, 너무 깊은 중첩이나 큰 배열은 나누어 변환해 보세요.",
    "ipynb": "노트북 JSON 구조가 깨지지 않았는지 확인하고, 이미지·차트 출력이 많다면 Markdown 또는 DOCX로 내보낸 뒤 변환해 보세요.",
    "xlsx": "첫 번째 시트만 변환됩니다. 필요한 시트를 맨 앞으로 옮기고, 병합 셀·차트·이미지를 줄인 뒤 다시 시도하세요.",
    "xls": "가능하면 XLSX로 다시 저장하고, 필요한 시트를 맨 앞으로 옮긴 뒤 다시 시도하세요.",
    "csv": "구분자와 따옴표가 깨지지 않았는지 확인하고, Excel에서 CSV UTF-8로 다시 저장해 보세요.",
    "md": "Markdown 문법을 단순화하고, 복잡한 인라인 HTML이나 이미지가 많으면 제거한 뒤 다시 시도하세요.",
    "markdown": "Markdown 문법을 단순화하고, 복잡한 인라인 HTML이나 이미지가 많으면 제거한 뒤 다시 시도하세요.",
    "html": "본문만 남긴 HTML로 다시 저장해 보세요. script, style, 외부 리소스, 복잡한 CSS 레이아웃은 변환 대상이 아닙니다.",
    "htm": "본문만 남긴 HTML로 다시 저장해 보세요. script, style, 외부 리소스, 복잡한 CSS 레이아웃은 변환 대상이 아닙니다.",
    "txt": "파일 인코딩을 UTF-8 또는 EUC-KR로 다시 저장한 뒤 시도하세요.",
    "text": "파일 인코딩을 UTF-8 또는 EUC-KR로 다시 저장한 뒤 시도하세요.",
}
OTHER_ADVICE = "파일을 다시 저장한 뒤 재시도하고, 계속 실패하면 더 단순한 입력 포맷(TXT, MD, DOCX)으로 변환해 보세요."
# Formats with styles of their own.
STYLED = ("docx", "html", "htm", "xlsx", "xls", "hwp", "hwpx")


def format_table(spark: SparkSession) -> DataFrame:
    """ext, preserved, lossy, advice, styled of the known formats."""
    rows = [(ext, *SUMMARIES[ext], ADVICE.get(ext, OTHER_ADVICE), ext in STYLED) for ext in SUMMARIES]
    return spark.createDataFrame(rows, "ext string, preserved string, lossy string, advice string, styled boolean")


def with_format(df: DataFrame, ext: str = "ext") -> DataFrame:
    """df with what is known of its extension; the general texts for others. The table is as small as the list of formats."""
    known = format_table(df.sparkSession).withColumnRenamed("ext", "_ext")
    out = df.join(F.broadcast(known), F.lower(F.col(ext)) == F.col("_ext"), "left").drop("_ext")
    return out.withColumns({"preserved": F.coalesce("preserved", F.lit(OTHER_SUMMARY[0])), "lossy": F.coalesce("lossy", F.lit(OTHER_SUMMARY[1])), "advice": F.coalesce("advice", F.lit(OTHER_ADVICE)), "styled": F.coalesce("styled", F.lit(False))})


def has_own_styles(ext: Column) -> Column:
    return F.coalesce(F.lower(ext).isin(*STYLED), F.lit(False))


def style_options(ext: Column, policy: Column, given: dict[str, Column]) -> Column:
    """Options as given (paragraph_spacing, heading_style, table_style, link_style, image_width), but for formats with styles of their own: 'balanced' takes
    standard headings and tables, and 'source' the plainest of all."""
    own = has_own_styles(ext)
    balanced, source = own & (policy == "balanced"), own & ~policy.isin("app", "balanced")
    fixed = {"paragraph_spacing": (None, "compact"), "heading_style": ("standard", "standard"), "table_style": ("standard", "standard"), "link_style": (None, "blue"), "image_width": (None, 100)}
    out = []
    for name, (middle, plain) in fixed.items():
        value = F.when(source, plain)
        if middle is not None:
            value = value.when(balanced, middle)
        out.append(value.otherwise(given[name]).alias(name))
    return F.struct(*out)


def metric_class(value: Column) -> Column:
    return F.when(value >= 85, "high").when(value >= 65, "mid").otherwise("low")


def date_stamp(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def long_date(day: Column) -> Column:
    return F.concat(F.year(day), F.lit("년 "), F.month(day), F.lit("월 "), F.dayofmonth(day), F.lit("일"))
