"""Default target-account profile and field mapping.

FIXED VALUES: the stock configuration, as data. Both are normally replaced by a
user's own YAML (``Profile.load`` / ``Mapping.load``).
"""

from __future__ import annotations

PROFILE = {
    "name": "B2B video platform ICP",
    "description": (
        "We sell a video hosting and video marketing platform to B2B software and "
        "services companies. The buyer is a marketing leader who already produces "
        "video and needs hosting, analytics, and lead capture that feed the CRM. "
        "A great account already treats content as a demand-gen channel and has "
        "enough marketing headcount to run it."
    ),
    "good_fit": [
        "B2B SaaS or B2B services company",
        "publishes a blog, webinars, customer stories, or a resource library",
        "already embeds video on marketing pages",
        "runs demand generation with gated content and forms",
        "uses a marketing automation platform such as HubSpot or Marketo",
        "50 to 2000 employees, mid-market rather than enterprise procurement",
        "has a pricing page and a self-serve or demo-led funnel",
    ],
    "poor_fit": [
        "consumer social or entertainment streaming",
        "video hosting or video platform competitor",
        "pre-launch, stealth, or a placeholder landing page",
        "agency reselling to many small clients",
        "regulated buyer requiring on-premise deployment only",
    ],
    "scoring_notes": (
        "80-100: clearly runs content marketing at scale and shows video on the page. "
        "60-79: right shape of company, but no direct evidence of a video program. "
        "40-59: plausible but the page is generic or the segment is unclear. "
        "0-39: wrong segment, a competitor, or too little on the page to judge."
    ),
    "heuristic_keywords": {
        "good": [
            "webinar", "case study", "customer story", "resource library",
            "demand generation", "book a demo", "request a demo", "marketing team",
            "hubspot", "marketo", "for teams", "free trial", "watch the video",
        ],
        "poor": [
            "video hosting", "video player", "live streaming", "coming soon",
            "stealth mode", "for creators", "our agency",
        ],
    },
}

MAPPING = {
    "objects": {"hubspot": "companies", "salesforce": "Account"},
    "match_keys": {"hubspot": "domain", "salesforce": "Website"},
    # source path, value type, property name per destination
    "fields": [
        {"source": s, "type": t, "hubspot": h, "salesforce": f}
        for s, t, h, f in (
            ("analysis.company_name", "string", "name", "Name"),
            ("analysis.one_liner", "string", "gtm_one_liner", "GTM_One_Liner__c"),
            ("analysis.category", "string", "gtm_category", "GTM_Category__c"),
            ("analysis.sells_to", "string", "gtm_sells_to", "GTM_Sells_To__c"),
            ("analysis.segment", "string", "gtm_segment", "GTM_Segment__c"),
            ("analysis.business_model", "string", "gtm_business_model", "GTM_Business_Model__c"),
            ("analysis.industries_served", "list", "gtm_industries_served", "GTM_Industries_Served__c"),
            ("analysis.icp_fit_score", "number", "gtm_icp_fit_score", "GTM_ICP_Fit_Score__c"),
            ("analysis.icp_fit_rationale", "string", "gtm_icp_fit_rationale", "GTM_ICP_Fit_Rationale__c"),
            ("analysis.buying_signals", "list", "gtm_buying_signals", "GTM_Buying_Signals__c"),
            ("analysis.disqualifiers", "list", "gtm_disqualifiers", "GTM_Disqualifiers__c"),
            ("analysis.primary_cta", "string", "gtm_primary_cta", "GTM_Primary_CTA__c"),
            ("analysis.confidence", "number", "gtm_enrichment_confidence", "GTM_Enrichment_Confidence__c"),
            ("tech_signals", "list", "gtm_tech_signals", "GTM_Tech_Signals__c"),
            ("page_signals.has_pricing_page", "boolean", "gtm_has_pricing_page", "GTM_Has_Pricing_Page__c"),
            ("page_signals.has_demo_cta", "boolean", "gtm_has_demo_cta", "GTM_Has_Demo_CTA__c"),
            ("page_signals.has_careers_page", "boolean", "gtm_has_careers_page", "GTM_Has_Careers_Page__c"),
            ("provenance.source_url", "string", "gtm_enriched_from_url", "GTM_Enriched_From_URL__c"),
            ("provenance.analyzed_at", "datetime", "gtm_enriched_at", "GTM_Enriched_At__c"),
            ("provenance.analyzer", "string", "gtm_enrichment_source", "GTM_Enrichment_Source__c"),
            ("provenance.content_hash", "string", "gtm_source_content_hash", "GTM_Source_Content_Hash__c"),
        )
    ],
}
